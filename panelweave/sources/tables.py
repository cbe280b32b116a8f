"""Scans, snapshots and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


REPORT_ROWS = 100_000


def scan(
    spark: SparkSession, folder: str, name: str, *columns: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One parquet table of a folder; the column list reaches the scan.

    A declared schema saves the job that reads it from the files.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_text(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """Raw zone: a delimited file with every column as text, named by position.

    Header and unit lines stay in; drop them by what they contain, since file order is
    not kept by a distributed read.
    """
    return spark.read.schema(text_schema(names)).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def typed(
    raw: DataFrame, types: dict[str, str], positions: list[int] | None = None, nulls: tuple[str, ...] = ("-", ""), failed: str | None = None
) -> DataFrame:
    """Typed zone: one projection of the raw text columns.

    ``types`` gives the new names and types in order; ``positions`` picks the raw columns
    (all of them, in order, by default). Markers in ``nulls`` and texts that do not parse
    become NULL; ``failed`` names a column that lists, by comma, the new columns whose text did not parse, so no row
    is lost or silently emptied.
    """
    sources = [raw.columns[i] for i in positions] if positions is not None else raw.columns
    out, bad = [], []
    for src, (name, kind) in zip(sources, types.items(), strict=True):
        text = F.when(~F.trim(src).isin(*nulls), F.trim(src))
        value = text if kind == "string" else text.try_cast(kind)
        out.append(value.alias(name))
        bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
    if failed:
        out.append(F.array_join(F.array_compact(F.array(*bad)), ",").alias(failed))
    return raw.select(*out)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Stage table, optionally partitioned by column.

    The rebalance hint groups rows by the partition columns and lets AQE cut large values
    into, and merge small ones up to, files of the advisory size.
    """
    if partition:
        df = df.hint("rebalance", *[F.col(c) for c in partition])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, single_file: bool = False) -> None:
    """Result table as CSV, in order over its files. ``single_file`` is meant for report tables: more than ``REPORT_ROWS`` rows are refused."""
    if order:
        df = df.orderBy(*order)
    if single_file:
        if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
            raise ValueError(f"more than {REPORT_ROWS} rows are written to several files, not through one task")
        df = df.coalesce(1)
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline dimension rows; a local relation whose exact size the planner knows."""
    return spark.createDataFrame(rows, schema)
