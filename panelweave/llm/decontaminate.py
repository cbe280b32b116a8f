"""Benchmark decontamination: short items searched inside long documents by containment.

Items are partitioned by their number of word shingles, in powers of two. An item of a class
with at most u shingles is kept by a bottom-k MinHash sketch of k = u - ceil(t*u) + 1 shingle
hashes (all of them if it has fewer). A document that contains a share t or more of the item has
at least one hash of that sketch, so no containing document is missed: the sketch is as long as
the size class needs and no longer. Documents are long and items short, so a document is not
sketched itself; every shingle hash of it is held against the sketches, first by a bitmap of
fixed size, then by a join. Candidates are verified by counting the item's shingles, as texts,
that the document has. An item with fewer words than a shingle is one short shingle; where there are such items, the documents
also give their shingles of those lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.llm.base import ascii_lower, free_name, let, shingle_hashes, slices, table, words_of
from panelweave.llm.keyfilter import as_array, key_filter, np_has, rows_with_keys, split_by_keys
from panelweave.session import stage


def _hashes(width: int, bits=None, short: tuple[int, ...] = ()):
    """Map (key, text) to (key, h): the distinct shingle hashes of each row, also of the ``short`` lengths, those in the bitmap only if there is one."""
    def run(batches):
        kept = bits.value if bits is not None else None
        for batch in batches:
            for at, part in slices(batch.column("text")):
                found = [shingle_hashes(part, n) for n in (width, *short)]
                row, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if kept is not None:
                    hit = np_has(kept, h)
                    row, h = row[hit], h[hit]
                pairs = np.unique(np.rec.fromarrays([row, h])) if len(row) else None
                row, h = (pairs["f0"], pairs["f1"]) if pairs is not None else (row, h)
                keys = batch.column("key").slice(at, len(part)).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(h.view(np.int64))], names=["key", "h"])

    return run


def shingle_texts(text: Column, width: int, short: tuple[int, ...] = ()) -> Column:
    """The distinct word shingles of a text, lower-cased, and those of the ``short`` lengths; the whole sequence if it is shorter than ``width``, none without a word."""
    def windows(words: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, n)))

    def runs(words: Column) -> Column:
        every = F.array_distinct(F.concat(*[windows(words, n) for n in (width, *short)]))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(every)

    return let(words_of(ascii_lower(text.cast("string"))), runs)


def item_sketches(items: DataFrame, width: int, share: float) -> DataFrame:
    """(h, item): the bottom-k hashes of each item; k follows from its size class."""
    hashes = items.select(F.col("item").alias("key"), "text").mapInArrow(_hashes(width), f"key {items.schema['item'].dataType.simpleString()}, h long")
    own = W.partitionBy("key")
    sized = hashes.distinct().withColumn("n", F.count(F.lit(1)).over(own))
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    k = top - F.ceil(top * F.lit(share) - 1e-9) + 1
    return sized.withColumn("r", F.row_number().over(own.orderBy("h"))).filter(F.col("r") <= k).select("h", F.col("key").alias("item"))


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int = 5, share: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, n_shingles of the item, n_shared, containment) where containment is ``share`` or more.

    Shingles are sets of ``width`` lower-cased words; an item or text with fewer words has one, all its words, and an
    empty or NULL one has none and matches nothing. An item with fewer words is found inside longer texts as well. Repeated rows of a document or item count once; rows of one id with other
    texts are judged each and listed once per id at their largest containment. NULL ids are kept as ids. Empty tables give no rows.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    wanted = stage(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    lengths = wanted.select(F.size(words_of(F.col("text"))).alias("n")).filter((F.col("n") > 0) & (F.col("n") < width)).distinct()
    short = tuple(sorted(r["n"] for r in lengths.collect()))  # width - 1 lengths at most
    sketches = stage(item_sketches(wanted, width, share), "sketches")
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(as_array(key_filter(sketches, {"h": F.col("h")}), "h"))
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    hits = texts.select(digest.alias("key"), "text").mapInArrow(_hashes(width, bits, short), "key binary, h long")
    candidates = stage(hits.join(sketches, "h").select("key", "item").distinct(), "candidates")

    # verification: candidate documents only, once per distinct text
    place = F.xxhash64("key")
    found = rows_with_keys(texts.withColumn("key", digest), key_filter(candidates, {"k": place}), place, "k")
    pairs = candidates.join(wanted.select("item", "item_id", F.explode(shingle_texts(F.col("text"), width)).alias("s")), "item")
    sizes = wanted.select("item", F.size(shingle_texts(F.col("text"), width)).alias("n_shingles"))
    own = found.select("key", "text").join(candidates.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    shingles = own.select("key", F.explode(shingle_texts(F.col("text"), width, short)).alias("s"))
    shared = pairs.join(shingles, ["key", "s"]).groupBy("key", "item", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    judged = shared.join(sizes, "item").withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(
        F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(share) - 1e-9)
    )
    return found.select("id", "key").join(judged, "key").groupBy(F.col("id").alias(doc_id), F.col("item_id").alias(item_id)).agg(
        F.max(F.struct("containment", "n_shared", "n_shingles")).alias("m")
    ).select(doc_id, item_id, "m.n_shingles", "m.n_shared", "m.containment")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns as given, whatever their names. A row goes by its own text, whatever its id.

    NULL and empty texts stay, repeated rows stay or go together, and without items everything stays. An empty table gives no rows.
    """
    key = free_name(docs, "_text_key")
    of = free_name(docs, "_leak")
    digest = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    keyed = docs.withColumn(key, digest)
    leaks = stage(
        contained_items(keyed, items, key, text, item_id, item_text, width, share).select(F.col(key).alias(of)).distinct(), "leaks"
    )
    place = F.xxhash64(F.col(key))
    maybe, clean = split_by_keys(keyed, key_filter(leaks, {"k": F.xxhash64(of)}), place, "k")
    left = maybe.join(leaks, F.col(key) == F.col(of), "left_anti")
    return clean.unionByName(left).drop(key)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contained_items(docs, items, "doc_id", "text", "item_id", "text")


OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, w, unnest(list_transform(range(1, greatest(2, len(w) - n + 2)), lambda k: array_to_string(w[k:k+n-1], ' '))) AS s
       FROM d, (VALUES (1), (2), (3), (4), (5)) v(n) WHERE len(w) > 0 AND (n = 5 OR n IN (SELECT len(w) FROM i))),
iss AS (SELECT DISTINCT item_id, w, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, w, count(*) AS n_shingles FROM iss GROUP BY 1, 2),
m AS (SELECT doc_id, ds.w AS dw, iss.item_id, iss.w AS iw, count(*) AS n_shared FROM ds JOIN iss USING (s) GROUP BY 1, 2, 3, 4),
r AS (SELECT doc_id, m.item_id, n_shared / n_shingles AS containment, n_shared, n_shingles
      FROM m JOIN n ON m.item_id = n.item_id AND m.iw = n.w WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9))
SELECT doc_id, item_id, CAST(max(n_shingles) AS INTEGER) AS n_shingles, max(n_shared) AS n_shared, max(containment) AS containment FROM r GROUP BY 1, 2
"""
