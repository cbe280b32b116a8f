"""Substring dedup by sliding sentence spans.

A sentence ends at a line feed or at a full stop, exclamation or question mark before space. From every sentence, and up to every
sentence, the run of consecutive sentences is hashed that is as short as it can be with ``passage_words`` words; together these runs cover every
passage of whole sentences with so many words, however many sentences it has. Runs of a fixed number of sentences can be hashed besides. Runs are counted over all documents with partial
aggregation, so a passage that a third of the documents share stays a small row; the runs found more than once,
with the place of the first, are joined back. Sentences covered by a repeated run that is not the first are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import SPACE, ascii_lower, buffers, let, mixed, slices, table, word_codes, word_hashes
from panelweave.llm.keyfilter import key_filter, rows_with_keys, split_by_keys
from panelweave.session import stage

BREAK = r"(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=\n)"


def sentences(text: Column) -> Column:
    """The text cut into sentences, which joined give the text again; parts without a word are sentences too."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), BREAK, -1)


def _runs(parts: Column, span: int, least_words: int) -> Column:
    """(sentence number, hash) of each run with ``least_words`` or more words; sentences without a word are skipped over."""
    def plain(s: Column) -> Column:
        return F.trim(F.regexp_replace(ascii_lower(s), SPACE, " "))

    def build(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - span)
        runs = F.transform(starts, lambda i: F.struct(
            F.get(w, i)["at"].alias("first"), F.get(w, i + span - 1)["at"].alias("last"),
            F.aggregate(F.slice(w, i + 1, span), F.lit(0), lambda a, x: a + x["n"]).alias("n"),
            F.xxhash64(*[F.get(w, i + k)["h"] for k in range(span)]).alias("h"),
            F.xxhash64(F.lit(1), *[F.get(w, i + k)["h2"] for k in range(span)]).alias("h2")))
        return F.when(F.size(w) >= span, F.filter(runs, lambda r: r["n"] >= least_words))

    cells = F.transform(parts, lambda s, i: let(plain(s), lambda p: F.struct(
        i.alias("at"), F.xxhash64(p).alias("h"), F.xxhash64(F.lit(7), p).alias("h2"),
        F.when(p == "", F.lit(0)).otherwise(F.length(p) - F.length(F.replace(p, F.lit(" "))) + 1).alias("n"))))
    return let(F.filter(cells, lambda c: c["n"] > 0), build)


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _passages(texts: pa.Array, words: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, h, h2): the shortest run from each sentence on, and up to each sentence, that has ``words`` words, and the whole text.

    first and last are sentence numbers. A run's hash comes from prefix sums over its words, in which the first word of a sentence has
    another value than elsewhere, so runs are equal if their words and sentence ends are. The whole text is equal to other whole texts only.
    """
    raw, at = buffers(texts)
    row, code, distinct = word_codes(texts)
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    before = np.concatenate([[True], blank[:-1]])
    before[at[:-1][at[:-1] < len(raw)]] = True
    start = np.flatnonzero(~blank & before)
    # a sentence begins after a line feed, and at a blank after a full stop, exclamation or question mark
    stop = np.isin(raw, np.frombuffer(b".!?", np.uint8))
    breaks = np.zeros(len(raw) + 1, dtype=np.int64)
    breaks[1:] = (raw == 0x0A) | (stop & np.concatenate([blank[1:], [False]]))
    breaks[at] = 0  # a break at the end of a text belongs to no word, and the next text starts anew
    number = np.cumsum(breaks)
    number = number[start] - number[at[:-1]][row]
    opens = np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])])
    first = np.flatnonzero(opens)  # first word of each sentence that has one
    end = np.append(first[1:], len(row))
    of, place = row[first], number[first]
    value = mixed(word_hashes(distinct))[code]
    value = np.where(opens, mixed(value + np.uint64(0x2545F4914F6CDD1D)), value)
    sums = []
    with np.errstate(over="ignore"):
        for base in BASES:
            power = _powers(base, len(row))
            back = _powers(pow(base, -1, 1 << 64), len(row))
            total = np.zeros(len(row) + 1, dtype=np.uint64)
            np.cumsum(value * power[:-1], out=total[1:])
            sums.append((total, back))

        def hashes(a: np.ndarray, b: np.ndarray, kind: int) -> list[np.ndarray]:
            size = (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind)
            return [mixed((total[b] - total[a]) * back[a] + size).astype(np.int64) for total, back in sums]

        many = np.arange(len(first))
        to = np.searchsorted(end, first + words, "left")
        fits = (to < len(first)) & (of[np.minimum(to, len(first) - 1)] == of)
        on = many[fits], to[fits]
        since = np.searchsorted(first, end - words, "right") - 1
        fits = (since >= 0) & (of[np.maximum(since, 0)] == of)
        up = since[fits], many[fits]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        whole = heads, np.append(heads[1:], len(first)) - 1
        # a run is often the shortest from its first sentence on and up to its last one too
        runs = np.unique(np.concatenate([on[0] * len(first) + on[1], up[0] * len(first) + up[1]]))
        parts = []
        for (i, j), kind in ((np.divmod(runs, max(1, len(first))), 1), (whole, 2)):
            parts.append((of[i], place[i], place[j], *hashes(first[i], end[j], kind)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _passage_rows(words: int):
    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column("text"), 1 << 19):
                row, first, last, h, h2 = _passages(part, words)
                own = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(own), batch.column("key").take(own), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h), pa.array(h2)],
                    names=["id", "key", "first", "last", "h", "h2"])

    return run


def drop_repeated_spans(
    docs: DataFrame, doc_id: str, text: str, span: int | None = 3, least_words: int = 12, passage_words: int | None = None
) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text without the removed sentences), one row per input row.

    The first of equal runs is the one with the least id (NULL last), then text key, then position. Runs in repeated rows of the same id and
    text are the same run at the same place, so repeated rows keep or lose the same sentences. A NULL or empty text has one empty sentence and
    stays empty. Other columns are not read and may have any name. An empty table gives no rows.

    With ``passage_words`` every repeated passage of whole sentences that has so many words is found, whatever the number of its sentences,
    and every text equal to another one as a whole. With ``span`` runs of exactly so many sentences with ``least_words`` words or more are found too.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    keyed = rows.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    kind = keyed.schema["id"].dataType.simpleString()
    runs = keyed.select("id", "key", F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("h2")).limit(0)
    if span is not None:
        found = _runs(sentences(F.col("text")), span, least_words)
        runs = runs.unionByName(keyed.select("id", "key", F.explode(found).alias("r")).select("id", "key", "r.*").drop("n"))
    if passage_words is not None:
        runs = runs.unionByName(keyed.mapInArrow(_passage_rows(passage_words), f"id {kind}, key long, first int, last int, h long, h2 long"))
    # hashes are counted first, as most runs occur once; the others are made again and come with their places
    counts = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    near = stage(rows_with_keys(runs, key_filter(stage(counts, "counts"), {"h": F.col("h")}), F.col("h"), "h"), "near")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", F.col("first").alias("at"))
    groups = near.groupBy("h", "h2").agg(F.min(place).alias("least"), F.max(place).alias("greatest"))
    repeated = stage(groups.filter("least <> greatest").select("h", "h2", "least"), "repeated")
    again = near.join(repeated, ["h", "h2"]).filter(place != F.col("least"))
    # the runs of a text, not their sentences, are brought together: two for each of its sentences at most
    ranges = again.groupBy("id", "key").agg(F.collect_set(F.struct("first", "last")).alias("r"))
    listed = F.flatten(F.transform("r", lambda x: F.sequence(x["first"], x["last"])))
    cut = stage(ranges.select("id", "key", F.sort_array(F.array_distinct(listed)).alias("cut")), "cut")
    own = F.xxhash64("id", "key")
    return _apply(keyed, cut, own).select(F.col("id").alias(doc_id), "n_sentences", "n_removed", F.col("kept").alias(text))


def _apply(keyed: DataFrame, cut: DataFrame, own: Column) -> DataFrame:
    maybe, clean = split_by_keys(keyed, key_filter(cut, {"k": own}), own, "k")
    right = cut.select(F.col("id").alias("cut_id"), F.col("key").alias("cut_key"), "cut")
    joined = maybe.join(right, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key")), "left")
    both = joined.select("id", "text", "cut").unionByName(clean.select("id", "text", F.lit(None).cast("array<int>").alias("cut")))
    none = F.col("cut").isNull()

    def kept(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "")

    return both.select(
        "id",
        F.size(sentences(F.col("text"))).alias("n_sentences"),
        F.when(none, F.lit(0)).otherwise(F.size("cut")).alias("n_removed"),
        F.when(none, F.coalesce("text", F.lit(""))).otherwise(let(sentences(F.col("text")), kept)).alias("kept"),
    )


def op5_sentence_spans(spark, sf_dir: str) -> DataFrame:
    found = drop_repeated_spans(table(spark, sf_dir, "documents"), "doc_id", "text", span=None, passage_words=50)
    return found.select("doc_id", "n_sentences", "n_removed", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP5_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, string_split(regexp_replace(regexp_replace(t, '([.!?])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), '\n', chr(10) || chr(1), 'g'), chr(1)) AS a FROM d),
s AS (SELECT doc_id, t, a, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s FROM p),
q AS (SELECT doc_id, t, i, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM s),
w AS (SELECT *, md5(t) AS key, len(string_split(s, ' ')) AS n, row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS j FROM q WHERE s <> ''),
c AS (SELECT doc_id, key, j, n, sum(n) OVER (PARTITION BY doc_id, key ORDER BY j) AS m FROM w),
l AS (SELECT doc_id, key, list(s ORDER BY j) AS ss, list(i ORDER BY j) AS ii, count(*) AS z FROM w GROUP BY 1, 2),
g AS (SELECT x.doc_id, x.key, x.j AS a, y.j AS b FROM (SELECT *, m - n + 50 AS o FROM c) x ASOF JOIN c y ON x.doc_id = y.doc_id AND x.key = y.key AND x.o <= y.m
      UNION SELECT x.doc_id, x.key, y.j, x.j FROM (SELECT *, m - 50 AS o FROM c) x ASOF JOIN (SELECT *, m - n AS o FROM c) y ON x.doc_id = y.doc_id AND x.key = y.key AND x.o >= y.o),
r AS (SELECT doc_id, key, ii[a] AS a, ii[b] AS b, 'run' || array_to_string(ss[a:b], chr(1)) AS x FROM g JOIN l USING (doc_id, key)
      UNION ALL SELECT doc_id, key, ii[1], ii[z], 'whole' || array_to_string(ss, chr(1)) FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, key, a) AS k FROM r),
u AS (SELECT DISTINCT doc_id, key, unnest(range(a, b + 1)) AS i FROM f WHERE k > 1),
o AS (SELECT s.doc_id, s.t, count(*) AS n_sentences, count(u.i) AS n_removed, coalesce(string_agg(s.s, '' ORDER BY s.i) FILTER (u.i IS NULL), '') AS k
      FROM s LEFT JOIN u ON s.doc_id = u.doc_id AND md5(s.t) = u.key AND s.i = u.i GROUP BY 1, 2)
SELECT documents.doc_id, CAST(n_sentences AS INTEGER) AS n_sentences, CAST(n_removed AS INTEGER) AS n_removed, CAST(length(k) AS INTEGER) AS kept_chars, md5(k) AS kept_md5
FROM documents JOIN o ON documents.doc_id = o.doc_id AND coalesce(documents.text, '') = o.t
"""
