"""Exact dedup as a stream with state that never expires.

The texts are read as a file stream. The keyed state, in RocksDB on disk, holds per digest of the normalised text how many rows
there are, the greatest id (the stable identifier of the row that stays) and where its text lies (file and row in it); no text is in
the state and no watermark lets a digest expire. The stream stops when it has read what there is; started again on the same
checkpoint it goes on with new files only. Rows of one digest are combined in the reading tasks, so a text that a third of the rows
share is a few rows in the shuffle.

A digest is only a promise. On a hit, the bytes of the row's text are compared with the retained one: the texts of rows
whose digest occurs twice or more are grouped by (digest, text), with the same combination in the reading tasks, and the group that holds
the row named by the state is the retained text. Rows in other groups share a digest but not the text, and form classes of their own.

DataFrame functions only.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.llm.base import UPPER, LOWER
from panelweave.llm.keyfilter import key_filter, may_have
from panelweave.session import stage, stage_path

# a store holds a few MB of files set aside in advance unless told not to, which for many small partitions is more than the state
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _disk_state(spark: SparkSession):
    """The session with the settings of the state store; they are as before afterwards."""
    old = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """A-Z lower-cased, NULL as empty. Lower-casing a text of ASCII characters only is the same and quicker."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, file, row, t) of a batch or stream read from Parquet files."""
    return docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        normalised(F.col(f"`{text}`")).alias("t"))


def _folder(path: str) -> str:
    """A pattern that fits the path only; the stream source takes a single file by pattern, not by name."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/{{{name}}}"


def ingest(
    spark: SparkSession, path: str, checkpoint: str, doc_id: str, text: str, digest=sha256_digest, batch_bytes: int = 1 << 40, batch_files: int | None = None
) -> None:
    """Read what is new in the Parquet table at ``path`` into the state under ``checkpoint``.

    A micro-batch takes files of ``batch_bytes`` together (or ``batch_files`` files). A batch that failed is taken again from the state before it.
    """
    with _disk_state(spark):
        reader = spark.readStream.schema(spark.read.parquet(path).schema)
        reader = reader.option("maxFilesPerTrigger", batch_files) if batch_files else reader.option("maxBytesPerTrigger", batch_bytes)
        rows = _rows(reader.parquet(_folder(path)), doc_id, text).select(digest(F.col("t")).alias("digest"), F.struct("id", "file", "row").alias("place"))
        kept = rows.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep: id, file and row of the row that stays, n: rows with the digest), read from the state."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def exact_groups(
    spark: SparkSession, path: str, doc_id: str, text: str, digest=sha256_digest, checkpoint: str | None = None, batch_bytes: int = 1 << 40, batch_files: int | None = None
) -> DataFrame:
    """(doc_id, file, row, keep_id, group_size, kept, digest), one row per row of the Parquet table at ``path``.

    Of rows with equal normalised text the one with the greatest id stays (NULL last; of repeated ids the one in the last file and row), so one row
    of a group is kept. A NULL text is an empty one. Other columns are not read and may have any name. An empty table gives no rows. ``digest`` may be any
    function of the text; classes are right even if different texts share one. Without ``checkpoint`` the state lies in the stage folder.
    """
    checkpoint = checkpoint or stage_path(spark, "exact-state")
    ingest(spark, path, checkpoint, doc_id, text, digest, batch_bytes, batch_files)
    with _disk_state(spark):
        repeated = stage(retained(spark, checkpoint).filter("n > 1"), "repeated")
    rows = _rows(spark.read.parquet(path), doc_id, text).withColumn("digest", digest(F.col("t")))
    seen, has = may_have(rows, key_filter(repeated, {"k": F.xxhash64("digest")}), F.xxhash64("digest"), ["k"])
    # the one pass over the texts: texts go on only where the digest may have been seen before
    ledger = stage(seen.select("id", "file", "row", "digest", F.when(has["k"], F.col("t")).alias("t")), "ledger")
    hits, single = ledger.filter("t IS NOT NULL"), ledger.filter("t IS NULL")

    # full bytes: one group per (digest, text); the group of the retained row is the retained text
    contents = hits.groupBy("digest", "t").agg(F.max(F.struct("id", "file", "row")).alias("own"), F.count(F.lit(1)).alias("size"))
    named = repeated.select(F.col("digest").alias("of"), "keep")
    texts = stage(contents.join(named, F.col("digest") == F.col("of"), "left").withColumn(
        "same", F.when(F.col("of").isNull(), F.col("size") == 1).otherwise(F.col("own") == F.col("keep"))).select("digest", "t", "own", "size", "same"), "contents")
    plain = texts.groupBy(F.col("digest").alias("of")).agg(
        F.max("own").alias("keep"), F.sum("size").alias("size"), ((F.count(F.lit(1)) == 1) & F.bool_and("same")).alias("one"))
    # written, so that the join below has exchanges of its own and a digest that many rows share can be split
    plain = stage(plain, "verified")
    one = plain.filter("one").select("of", "keep", "size")
    placed = hits.drop("t").join(one, F.col("digest") == F.col("of")).select("id", "file", "row", "digest", "keep", "size")
    if not plain.filter("NOT one").isEmpty():
        clash = stage(plain.filter("NOT one").select("of"), "clashes")
        apart = texts.join(clash, F.col("digest") == F.col("of")).select("of", F.col("t").alias("text_of"), F.col("own").alias("keep"), "size")
        placed = placed.unionByName(
            hits.join(apart, (F.col("digest") == F.col("of")) & (F.col("t") == F.col("text_of"))).select("id", "file", "row", "digest", "keep", "size"))
    alone = single.select("id", "file", "row", "digest", F.struct("id", "file", "row").alias("keep"), F.lit(1).cast("long").alias("size"))
    return placed.unionByName(alone).select(
        F.col("id").alias(doc_id), "file", "row", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"), "digest")


def op11_exact_stream(spark, sf_dir: str) -> DataFrame:
    rows = exact_groups(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS place, count(*) OVER (PARTITION BY t) AS group_size FROM d WINDOW g AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM w
"""
