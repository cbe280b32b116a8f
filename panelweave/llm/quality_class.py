"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed into buckets. The log ratio of the bucket's probability in
the target model and in the raw model, summed over a text, is its log importance weight. Adding
Gumbel noise and keeping the k largest draws k documents without replacement in proportion to their weights.

The target is fitted on a bounded number of labelled rows, the raw model on all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelweave.llm.base import mixed, slices, table, word_codes, word_hashes
from panelweave.session import stage

BUCKETS = 1 << 14
LABEL_LIMIT = 1 << 17
SMOOTH = BUCKETS / 2


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words and word pairs."""
    row, code, words = word_codes(texts)
    value = mixed(word_hashes(words))[code]
    pair = mixed(value[:-1] * np.uint64(0xD6E8FEB86659FD93) + value[1:])
    same = row[1:] == row[:-1]
    low = np.uint64(BUCKETS - 1)
    return np.concatenate([row, row[1:][same]]), np.concatenate([value & low, pair[same] & low]).astype(np.int64)


def _count(batches):
    sums = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for at, part in slices(batch.column("text")):
            row, bucket = _buckets(part)
            sums[0] += np.bincount(bucket, minlength=BUCKETS)
            sums[1] += np.bincount(bucket[target[at : at + len(part)][row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"])


def _weigh(shared):
    def run(batches):
        ratio = shared.value
        for batch in batches:
            weights, sizes = [], []
            for at, part in slices(batch.column("text")):
                row, bucket = _buckets(part)
                weights.append(np.bincount(row, ratio[bucket], len(part)))
                sizes.append(np.bincount(row, minlength=len(part)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
                 pa.array(np.concatenate(weights) if weights else np.zeros(0))], names=["id", "key", "n_features", "log_weight"]
            )

    return run


def top_k_threshold(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: four counts of 16 bits each, at most 65,536 rows a time to the driver."""
    at, prefix, left = F.col(key), None, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright(at, shift)
        here = rows if prefix is None else rows.filter(F.shiftright(at, shift + 16) == F.lit(prefix))
        counts = sorted(((r["p"], r["n"]) for r in here.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for p, n in counts:
            if left <= n:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


def importance_resample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, fraction: float | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, log_weight, selected).

    ``labels`` has doc_id, quality and toxic; an id is a target if all its rows are of quality 1 and none is toxic.
    At most ``LABEL_LIMIT`` target ids enter, by hash order. ``fraction`` of the rows are selected (default: the share of
    targets among labelled ids); rows that tie with the last one selected are selected too. A NULL or empty text has weight 0.
    NULL ids match no label. One row per input row; an empty table gives no rows, without targets all weights are 0.
    """
    spark = docs.sparkSession
    judged = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        (F.coalesce(F.min((F.col("quality") == 1).cast("int")), F.lit(0)) - F.coalesce(F.max(F.col("toxic")), F.lit(0)) > 0).alias("good")
    )
    share = judged.agg(F.coalesce(F.avg(F.col("good").cast("double")), F.lit(1.0)).alias("s")).first()["s"]
    targets = judged.filter("good").orderBy(F.xxhash64("id"), "id").limit(LABEL_LIMIT).select(F.col("id"), F.lit(True).alias("target"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    flagged = rows.join(F.broadcast(targets), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    sums = np.zeros((2, BUCKETS))
    for r in counts.collect():
        sums[:, r["bucket"]] = r["raw"], r["target"]
    # the target is smoothed towards the raw model, so that few labels pull weights to 0 and not down
    raw = (sums[0] + 0.5) / (sums[0] + 0.5).sum()
    ratio = np.log((sums[1] + SMOOTH * raw) / (sums[1].sum() + SMOOTH)) - np.log(raw)
    shared = spark.sparkContext.broadcast(ratio)
    kind = rows.schema["id"].dataType.simpleString()
    # noise by id and text, so that it is the same on every run
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.md5(F.coalesce("text", F.lit("")))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.select("id", "text", (-F.log(-F.log(uniform))).alias("key"))
    weighed = keyed.mapInArrow(_weigh(shared), f"id {kind}, key double, n_features long, log_weight double").withColumn("key", F.col("log_weight") + F.col("key"))
    # order-preserving: noise and weight to a millionth
    scored = stage(weighed.withColumn("rank_key", F.round(F.col("key") * 1e6).cast("long")), "weights")
    k = int(np.ceil((share if fraction is None else fraction) * scored.count() - 1e-9))
    least = top_k_threshold(scored, "rank_key", k) if k > 0 else None
    selected = F.lit(False) if least is None else F.col("rank_key") >= least
    return scored.select(F.col("id").alias(doc_id), "n_features", "log_weight", selected.alias("selected"))


def op7_importance(spark, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text")
