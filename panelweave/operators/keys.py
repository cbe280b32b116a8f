"""Key membership, code recoding and name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.session import stage


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is listed. A NULL key is never listed."""
    return df.join(keys.select(*on), on, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed. A NULL key is kept."""
    return df.join(keys.select(*on), on, "left_anti")


def drop_violating_units(df: DataFrame, unit: list[str], violation: Column) -> DataFrame:
    """Drop every row of a unit that has at least one violating row."""
    return non_members(df, df.filter(violation).select(*unit).distinct(), unit)


def first_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """First row per key in the stated order, as one partial aggregate without a sort."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def drop_duplicated_units(
    df: DataFrame, unit: str, keys: list[str], value: str, allowed: Column, sum_fn=F.sum
) -> DataFrame:
    """Duplicate-key rule: units that repeat a key are dropped whole, unless ``allowed``
    holds for them; the repeats of allowed units are summed."""
    offending = duplicate_keys(df, keys).filter(~allowed).select(unit).distinct()
    return non_members(df, offending, [unit]).groupBy(*keys).agg(sum_fn(value).alias(value))


def recode_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(ver1, ver2) pairs to a (from, to) map: exactly one side must be a known code.

    ``pairs`` carries a ``row`` column; where a code is mapped twice the lowest row wins.
    """
    listed = known.select(F.col("code")).filter("code IS NOT NULL").distinct()
    flagged = (
        pairs.join(listed.select(F.col("code").alias("ver1"), F.lit(True).alias("known1")), "ver1", "left")
        .join(listed.select(F.col("code").alias("ver2"), F.lit(True).alias("known2")), "ver2", "left")
        .select("row", "ver1", "ver2", F.col("known1").isNotNull().alias("k1"), F.col("known2").isNotNull().alias("k2"))
        .filter(F.col("k1") != F.col("k2"))
    )
    moved = flagged.select(
        "row",
        F.when(F.col("k1"), F.col("ver2")).otherwise(F.col("ver1")).alias("from"),
        F.when(F.col("k1"), F.col("ver1")).otherwise(F.col("ver2")).alias("to"),
    ).filter("`from` IS NOT NULL")
    return moved.groupBy("from").agg(F.min_by("to", F.struct("row", "to")).alias("to"))


def recode_column(df: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Replace mapped codes and leave the others as they are; of several targets of a code the least is taken."""
    mapping = mapping.groupBy(F.col("from").alias(code)).agg(F.min("to").alias("_to"))
    return df.join(mapping, code, "left").withColumn(code, F.coalesce("_to", code)).drop("_to")


def recode_apply(df: DataFrame, code: str, mapping: DataFrame, keys: list[str], value: str, sum_fn=F.sum) -> DataFrame:
    """Recode, then add up rows that fell onto the same key.

    The facts are summed per old key first, so the join sees one row per key.
    """
    partial = df.groupBy(*keys).agg(sum_fn(value).alias(value))
    return recode_column(partial, code, mapping).groupBy(*keys).agg(sum_fn(value).alias(value))


def recode_sums(sums: DataFrame, code: str, mapping: DataFrame, keys: list[str], value: str, sum_fn=F.sum) -> DataFrame:
    """Recode rows that are one per key already, and add up those that fell onto the same key.

    Only rows whose code is an end of the mapping can meet others. The rest, nearly all of them as a rule, go past the
    hash tables, which so hold what the mapping touches and not all keys. The mapping is read several times.
    """
    ends = mapping.select(F.col("from").alias(code)).unionByName(mapping.select(F.col("to").alias(code))).distinct()
    met = recode_column(members(sums, ends, [code]), code, mapping).groupBy(*keys).agg(sum_fn(value).alias(value))
    return non_members(sums, ends, [code]).select(*keys, value).unionByName(met)


def name_backfill(codes: DataFrame, code: str, sources: list[DataFrame], order: str, columns: list[str]) -> DataFrame:
    """First name row found for each code in source 1, then in source 2, and so on.

    A source may lack some of ``columns``; they stay NULL when it is the one used.
    """
    out = codes
    for i, src in enumerate(sources):
        have = [c for c in columns if c in src.columns]
        first = first_by(src.filter(F.col(code).isNotNull()), [code], [order], have)
        out = out.join(first.select(code, F.struct(*have).alias(f"_s{i}")), code, "left")
    hit = [F.col(f"_s{i}").isNotNull() for i in range(len(sources))]
    for c in columns:
        value = F.lit(None)
        for i in reversed(range(len(sources))):
            found = F.col(f"_s{i}.{c}") if c in sources[i].columns else F.lit(None)
            value = F.when(hit[i], found).otherwise(value)
        out = out.withColumn(c, value)
    return out.drop(*[f"_s{i}" for i in range(len(sources))])


def count_candidates(
    rows: DataFrame, dim: DataFrame, code: str = "code", name: str = "name", block: list[str] | str = "block", prefix_len: int = 2
) -> DataFrame:
    """``rows`` with ``n_candidates`` and ``to``: how many codes of the row's block have a name that contains the first
    ``prefix_len`` characters of its own name, and the least of them. Rows without a block or name have none.

    Candidates are indexed by the pieces of their names (every substring up to
    ``prefix_len`` characters) and counted per (block, piece) before the join, so a
    source row meets at most one index row and no pairs of a block are formed.

    The candidates are dealt in ranges of their code, sorted and written once with a number that follows the code. The least
    code of a piece is the one of least number, so the many pieces are counted in hash tables of fixed-width sums, one entry per
    (block, piece), and never sorted.
    """
    block = [block] if isinstance(block, str) else block
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))

    def cut(n: int) -> Column:
        return F.transform(at, lambda i: F.substr(F.col(name), i, F.lit(n)))

    windows = [cut(n) for n in range(1, prefix_len + 1)]
    pieces = F.array_distinct(F.concat(F.array(F.lit("")), *windows))
    listed = dim.filter(F.col(name).isNotNull()).select(*block, F.col(name), F.col(code).alias("to"))
    by_code = F.asc_nulls_last("to")  # a code is less than none
    ranged = listed.repartitionByRange(by_code).sortWithinPartitions(by_code)
    numbered = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "candidates")
    index = (
        numbered.select(*block, "_at", F.explode(pieces).alias("_piece"))
        .groupBy(*block, "_piece")
        .agg(F.count(F.lit(1)).alias("n_candidates"), F.min("_at").alias("_at"))
        .join(numbered.select("_at", "to"), "_at")
        .drop("_at")
    )
    keyed = rows.withColumn("_piece", F.substring(name, 1, prefix_len))
    return keyed.join(index, [*block, "_piece"], "left").drop("_piece").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def unique_fuzzy_match(
    unmatched: DataFrame,
    dim: DataFrame,
    code: str = "code",
    name: str = "name",
    block: list[str] | str = "block",
    prefix_len: int = 2,
    blacklist: DataFrame | None = None,
) -> DataFrame:
    """Map a code to the one candidate of its block whose name contains the first
    ``prefix_len`` characters of its own name; zero or several candidates give no map.

    ``blacklist`` names candidates that may count but not be chosen.
    """
    block = [block] if isinstance(block, str) else block
    rows = unmatched.filter(F.col(name).isNotNull()).select(F.col(code).alias("from"), *block, name)
    found = count_candidates(rows, dim, code, name, block, prefix_len).filter("n_candidates = 1")
    if blacklist is not None:
        found = non_members(found, blacklist.select(F.col(code).alias("to")), ["to"])
    return found.select("from", "to")


def unmatched_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``dim`` lacks, without NULL.

    Both sides go through one aggregate. A join would broadcast ``dim`` by its size on disk, and keys packed in Parquet
    take a hundred times that in memory.
    """
    flagged = df.select(key, F.lit(False).alias("_known")).unionByName(dim.select(key, F.lit(True).alias("_known")))
    known = flagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_known").alias("_known"))
    return known.filter(~F.col("_known")).select(key)


def located_share(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Share of ``value`` on known keys and on unknown ones, one row. A NULL key is unknown.

    The keys of both sides go through one aggregate, as in ``unmatched_keys``, so none are sorted or broadcast for a join.
    """
    listed = dim.filter(F.col(key).isNotNull()).select(key, F.lit(None).cast(df.schema[value].dataType).alias(value), F.lit(True).alias("_known"))
    per_key = df.select(key, value, F.lit(False).alias("_known")).unionByName(listed).groupBy(key).agg(F.sum(value).alias("_v"), F.max("_known").alias("_known"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_v"))), F.lit(0.0)).alias("located"),
        F.sum("_v").alias("total"),
    ).withColumn("unlocated_share", 1 - F.try_divide("located", "total"))
