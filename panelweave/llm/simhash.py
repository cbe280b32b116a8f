"""Near copies by bit fingerprints and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits share a variant in which each differs in at most
one bit. So every distinct fingerprint emits itself and its one-bit variants; fingerprints that
meet on a variant are at most 2 bits apart. Each meeting is linked to its least and greatest
member only, which keeps components and lists no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import Tally, free_name, frequent, shingle_hashes, slices, spread, table
from panelweave.llm.components import components
from panelweave.llm.keyfilter import key_filter, rows_with_keys, split_by_keys
from panelweave.session import stage

CHUNK = 1 << 16


def _shingle_bits(width: int):
    digest = xxhash.xxh64_intdigest

    def fingerprint(text: str | None) -> int:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return 0
        count = max(1, len(words) - width + 1)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, count, CHUNK):
            to = min(count, at + CHUNK)
            hashes = np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(at, to)), dtype="<u8", count=to - at)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        packed = np.packbits((2 * ones > count).astype(np.uint8), bitorder="little")
        return int(packed.view("<i8")[0])

    return fingerprint


def simhash(text: Column, width: int = 3) -> Column:
    """64-bit fingerprint: a bit is set if it is set in over half the XXH64 (seed 42) of the word shingles.

    A-Z are lower-cased; repeated shingles count each time; fewer words than ``width`` are one shingle; no word: 0.
    """
    one = _shingle_bits(width)

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="int64")

    # annotations as objects: this module's are strings
    batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "long")(text.cast("string"))


def hamming_links(prints: DataFrame, bits: int = 64) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp) that differ in at most 2 bits, enough to join each component."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(bits)])
    variants = spread(prints).select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    meetings = variants.groupBy("variant").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    # a meeting has at most bits + 1 members, so the members are the variants of the meeting that exist
    near = meetings.select("low", "variant", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("variant")))).alias("fp"))
    known = near.join(prints.select("fp"), "fp", "left_semi")
    return known.filter("fp <> low").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= 2).select(
        F.col("low").alias("u"), F.col("fp").alias("v")
    ).distinct()


def simhash_groups(docs: DataFrame, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: least doc_id reachable by links of at most 2 bits).

    One row per input row. A NULL or empty text has fingerprint zero and links like any other. A NULL id is
    ignored as a component's name unless it is the only one; repeated rows repeat. An empty table gives no rows. Other columns
    are ignored.
    """
    rows = stage(docs.select(F.col(doc_id).alias("id"), simhash(F.col(text), width).alias("fp")), "prints")
    prints = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    joined = components(hamming_links(prints))
    roots = joined.join(prints, joined["node"] == prints["fp"]).groupBy("root").agg(F.min("least").alias("name"))
    named = joined.join(roots, "root").select(F.col("node").alias("fp"), "name")
    names = prints.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    return rows.join(names, "fp", "left").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_simhash_copies(docs: DataFrame, doc_id: str, text: str, width: int = 3) -> DataFrame:
    """``docs`` with one row of each component of ``simhash_groups``; columns as given, whatever their names.

    The row with the least id stays (NULL last), of equal ids any fixed one, and of rows equal in all columns one. NULL and empty texts have
    fingerprint zero and are copies of each other and of what links to it. An empty table gives no rows. Rows must come the same on a second reading.
    """
    digest, rowhash = free_name(docs, "_digest"), free_name(docs, "_rowhash")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({digest: F.unhex(F.md5(body)), rowhash: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    rows = stage(keyed.select(F.col(f"`{doc_id}`").alias("id"), F.col(digest).alias("digest"), F.col(rowhash).alias("rowhash"), simhash(body, width).alias("fp")), "prints")
    equal = stage(rows.groupBy("fp", "digest", "id", "rowhash").agg(F.count(F.lit(1)).alias("c")), "equal")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rowhash", "digest")
    prints = stage(equal.groupBy("fp").agg(F.sum("c").alias("n"), F.min(place).alias("best")), "prints")
    linked = components(hamming_links(prints.select("fp")))
    rooted = prints.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "n", "best", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("n"), F.min("best").alias("best")).filter("n > 1")
    copies = stage(rooted.select(F.col("fp").alias("of"), "root").join(groups, "root").select("of", "best"), "copies")
    marked = equal.join(copies, F.col("fp") == F.col("of")).withColumn("stays", place == F.col("best"))
    of, least, stays = (free_name(keyed, c) for c in ("_of", "_least", "_stays"))
    marks = stage(marked.filter("NOT stays OR c > 1").select(F.col("digest").alias(of), F.col("rowhash").alias(least), F.col("stays").alias(stays)), "marks")
    maybe, alone = split_by_keys(keyed, key_filter(marks, {"k": F.xxhash64(of, least)}), F.xxhash64(digest, rowhash), "k")
    judged = maybe.join(marks, (F.col(digest) == F.col(of)) & (F.col(rowhash) == F.col(least)), "left")
    out = [F.col(f"`{c}`") for c in docs.columns]
    once = judged.filter(F.col(stays)).dropDuplicates([digest, rowhash]).select(*out)
    return alone.select(*out).unionByName(judged.filter(F.col(stays).isNull()).select(*out)).unionByName(once)


# Near copies of text at a similarity of word sets, for filtering. Texts of Jaccard similarity 0.8 differ in about 10 of
# 64 SimHash bits, too many for a ball of radius 2, so near copies are found by a prefix join of their shingles: of two sets with
# similarity t or more, each in one common order, the first n - ceil(t n) + 1 of the n shingles of either have one in common. This
# holds in any order; the order taken puts shingles that a sample shows to be common last. Candidates are verified on the shingles.
SAMPLE, COMMON_LIMIT = 16, 1 << 18
GROWTH = 8  # the share of a meeting's members that are compared with all others grows by this from round to round


def _counts(width: int):
    def run(batches):
        tally = Tally("h")
        for batch in batches:
            for _, part in slices(batch.column("text")):
                row, h = shingle_hashes(part, width)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = h[new].view(np.int64)
                yield from tally.add(pa.table({"h": at, "n": np.ones(len(at), np.int64)}))
        yield from tally.take()

    return run


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, class) of shingles that are common in a sample by digest, ``COMMON_LIMIT`` at most, sorted by hash; only for the order of the prefixes."""
    part = texts.filter(F.pmod(F.xxhash64("digest", F.lit(5)), F.lit(SAMPLE)) == 0).select("text")
    counted = stage(part.mapInArrow(_counts(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "common")
    found = frequent(counted, "n", COMMON_LIMIT).toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log2(found["n"].to_numpy()[order]).astype(np.int8) + 1


def _signatures(width: int, least: float, common: tuple[np.ndarray, np.ndarray]):
    """Map (id, digest, rowhash, text) to the same with the prefix of the text's shingles and their number in place of the text."""
    known, classes = common

    def run(batches):
        for batch in batches:
            lists, sizes = [], []
            for _, part in slices(batch.column("text")):
                row, h = shingle_hashes(part, width)
                rank = np.zeros(len(h), dtype=np.int8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, classes[at], rank)
                order = np.lexsort((h, rank, row))
                row, h = row[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                n = np.bincount(row, minlength=len(part))
                first = np.cumsum(n) - n
                size = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                kept = np.arange(len(h)) - first[row] < size[row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(part)))])
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[kept].view(np.int64))))
                sizes.append(n)
            kind = pa.list_(pa.int64())
            prefix = pa.concat_arrays(lists) if lists else pa.array([], kind)
            count = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "digest", "rowhash")], prefix, count], names=["id", "digest", "rowhash", "sign", "size"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column("text")):
                row, h = shingle_hashes(part, width)
                key = np.unique(row << 32 | (h >> np.uint64(32)).astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(part)))])
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(part)), sets], names=["node", "s"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have Jaccard ``least`` or more."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", shared.alias("n"), (F.size("a") + F.size("b")).alias("m")).filter(F.col("n") >= least * (F.col("m") - F.col("n")) - 1e-9).select("u", "v")


def near_copy_groups(classes: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root): groups of the nodes of ``classes`` (node, digest, sign, size) connected by Jaccard ``least`` or more of their shingle sets.

    Nodes that share a shingle of their prefixes meet. In each round the pivots of a meeting are compared with all its members of other groups,
    then leave it: first one member, then shares that grow until all have been pivots. A meeting ends when its members are one group. So
    a large group of copies is joined by a few comparisons for each member, and members that stay apart are all compared.
    """
    places = classes.filter("size > 0").select("node", "size", F.explode("sign").alias("at"))
    kept = stage(places.groupBy("at").agg(F.count(F.lit(1)).alias("k"), F.min(F.xxhash64("node")).alias("past")).filter("k > 1"), "meetings")
    met = rows_with_keys(places, key_filter(kept, {"a": F.col("at")}), F.col("at"), "a").join(kept.select("at"), "at")
    members = stage(met.select("at", "node", "size", F.xxhash64("node").alias("h")), "members")
    nodes = members.select("node").distinct()
    wanted = stage(classes.join(nodes, "node").select("node", "digest"), "wanted")
    place = F.xxhash64("digest")
    found = rows_with_keys(texts, key_filter(wanted, {"d": place}), place, "d").join(wanted, "digest")
    sets = stage(found.dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets(width), "node long, s array<int>"), "sets")
    members = members.withColumn("root", F.col("node"))
    links = groups = None
    share = 0
    while True:
        # (at, past, upto): members with h <= past have been pivots, those up to upto are the next; the first round takes the least h
        if share == 0:
            limits = kept.select("at", F.lit(None).cast("long").alias("past"), F.col("past").alias("upto"))
        else:
            def reach(n: int) -> Column:
                part = F.least(F.lit(1.0), F.lit(float(n)) / F.col("k"))
                bound = F.when(part >= 1.0, F.lit((1 << 63) - 1)).otherwise((part * float(1 << 63) * 2 - float(1 << 63)).cast("long"))
                return F.greatest(F.col("past"), bound)

            past = F.col("past") if share == 1 else reach(share)
            limits = kept.select("at", past.alias("past"), reach(share * GROWTH).alias("upto"))
        live = members.join(limits, "at").filter("past IS NULL OR h > past")
        left = live.filter("h <= upto").select("at", F.col("node").alias("p"), F.col("root").alias("r"), F.col("size").alias("c"))
        near = live.select("at", "node", "root", "size").join(left, "at").filter("root <> r")
        fits = F.least("size", "c") >= F.lit(least) * F.greatest("size", "c") - 1e-9
        pairs = stage(near.filter(fits).select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")).distinct(), "pairs")
        new = stage(_similar(pairs, sets, least), "links")
        links = new if links is None else links.unionByName(new)
        groups = stage(components(links), "groups")
        share = GROWTH * share if share else 1
        # meetings of one group, and of one member that has not been a pivot, are over
        rest = members.select("at", "node", "size", "h").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        state = rest.join(limits.select("at", "upto"), "at").groupBy("at").agg(
            F.count(F.when(F.col("h") > F.col("upto"), 1)).alias("open"), F.min("root").alias("low"), F.max("root").alias("high"))
        going = state.filter("open > 1 AND low <> high").select("at")
        kept = stage(kept.join(going, "at", "left_semi"), "meetings")
        if kept.isEmpty():
            return groups
        members = stage(rest.join(kept.select("at"), "at", "left_semi"), "members")


def drop_near_copies(docs: DataFrame, doc_id: str, text: str, width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of equal or similar texts; columns as given.

    Similar: Jaccard of the sets of ``width``-word shingles is ``least`` or more; groups are connected by such links. The row with the least
    id stays (NULL last), among equal ids any fixed one; of rows equal in all columns one. Texts without a word are
    equal only if they are the same; NULL is an empty text. Every pair of similarity ``least`` or more is found. An empty
    table gives no rows. Rows must come the same on a second reading.
    """
    digest, rowhash = free_name(docs, "_digest"), free_name(docs, "_rowhash")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({digest: F.unhex(F.md5(body)), rowhash: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    texts = keyed.select(F.col(f"`{doc_id}`").alias("id"), F.col(digest).alias("digest"), F.col(rowhash).alias("rowhash"), body.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    common = common_shingles(texts, width)
    signed = texts.mapInArrow(_signatures(width, least, common), f"id {kind}, digest binary, rowhash long, sign array<long>, size long")
    equal = signed.groupBy("digest", "id", "rowhash").agg(F.count(F.lit(1)).alias("c"), F.first("sign").alias("sign"), F.first("size").alias("size"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "rowhash", "digest", "c")
    classes = equal.groupBy("digest").agg(F.first("sign").alias("sign"), F.first("size").alias("size"), F.sum("c").alias("n"), F.min(best).alias("best"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    linked = near_copy_groups(classes, texts.select("digest", "text"), width, least)
    grouped = classes.drop("sign", "size").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = grouped.groupBy("root").agg(F.sum("n").alias("n"), F.min("best").alias("best")).filter("n > 1")
    of, least_row = free_name(keyed, "_of"), free_name(keyed, "_least_row")
    copies = stage(grouped.select("root", "digest").join(groups, "root").select(F.col("digest").alias(of), F.col("best").alias(least_row)), "copies")
    place = F.xxhash64(F.col(digest))
    maybe, alone = split_by_keys(keyed, key_filter(copies, {"d": F.xxhash64(of)}), place, "d")
    judged = maybe.join(copies, F.col(digest) == F.col(of), "left")
    stays = F.col(of).isNull() | ((F.col(f"{least_row}.digest") == F.col(digest)) & (F.col(f"{least_row}.rowhash") == F.col(rowhash)))
    many = F.coalesce(F.col(f"{least_row}.c") > 1, F.lit(False))
    kept = judged.filter(stays).withColumn(of, many)
    out = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter(F.col(of)).dropDuplicates([digest, rowhash]).select(*out)
    return alone.select(*out).unionByName(kept.filter(~F.col(of)).select(*out)).unionByName(once)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
