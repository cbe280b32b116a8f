"""Language ID by bit-sliced Bloom filters over byte n-grams.

Slot s of the filter holds a bit mask with one bit per language, so one look at k slots, joined
by AND, gives all languages that contain the n-gram. A text's votes are popcounts per bit over all
its n-grams. Of n votes asked of a language with false-positive rate f, f*n come by chance, so the
share (hits/n - f) / (1 - f) is compared.

An n-gram enters the filter of every language in which it makes up a share ``rate`` or more of the n-grams.
At most 1/rate n-grams of a language can do so, which bounds the filter whatever the corpus; a rarer one is
taken as not seen. A slot is a byte for up to eight languages, and words of 64 bits beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import Tally, buffers, fold, give_back, slices, table
from panelweave.session import stage

SLOTS, PROBES = 1 << 22, 3
SLICE = 1 << 18  # bytes of text looked at in one go; the n-gram arrays take some fifty times as much


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): runs of n bytes of the text between spaces, all non-letters of ASCII being spaces."""
    raw, at = buffers(texts)
    sizes = np.diff(at)
    line = np.full(len(raw) + 2 * len(sizes), 0x20, dtype=np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A)) | ((raw >= 0x41) & (raw <= 0x5A))
    line[np.arange(len(raw)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)] = np.where(letter, raw, 0x20)
    if len(line) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes + 2)
    gram = np.zeros(len(line) - n + 1, dtype=np.int64)
    blanks = np.zeros(len(gram), dtype=np.int8)
    for i in range(n):
        part = line[i : len(line) - n + 1 + i]
        gram <<= 8
        gram |= part
        blanks += part == 0x20
    same = row[: len(gram)] == row[n - 1 :]
    keep = same & (blanks <= 2) & (blanks < n)
    return row[: len(gram)][keep], gram[keep]


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    h = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def _count(n: int):
    def run(batches):
        tallies: dict[str, Tally] = {}

        def named(lang, parts):
            for b in parts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), b.column("gram"), b.column("n")], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for at, part in slices(batch.column("text"), SLICE):
                own = langs[at : at + len(part)]
                row, gram = _grams(part, n)
                for lang in set(own):
                    keys, count = np.unique(gram[(own == lang)[row]], return_counts=True)
                    tally = tallies.setdefault(lang, Tally("gram", 100_000))
                    yield from named(lang, tally.add(pa.table({"gram": keys, "n": count})))
        for lang, tally in tallies.items():
            yield from named(lang, tally.take())
        tallies.clear()
        give_back()

    return run


def _width(masks: np.ndarray) -> int:
    """Languages in one word of the masks."""
    return 8 * masks.itemsize


def _has(words: np.ndarray, bit: int) -> np.ndarray:
    return words >> words.dtype.type(bit) & words.dtype.type(1)


class LanguageFilters:
    """Languages in order of code point, the mask of each slot (words of 8 or 64 languages) and each language's false-positive rate."""

    def __init__(self, langs: list[str], masks: np.ndarray, n: int):
        self.langs, self.masks, self.n = langs, masks, n
        fill = [float(np.mean(_has(masks[:, i // _width(masks)], i % _width(masks)))) for i in range(len(langs))]
        self.false_rate = np.array(fill) ** PROBES


def learn_languages(docs: DataFrame, text: str, lang: str, n: int = 4, rate: float = 1e-5) -> LanguageFilters:
    """Filters from all rows with a language; NULL languages are left out, NULL or empty texts add nothing.

    Repeated rows count as often as they occur. Other columns are not read. An empty table gives filters without a language.
    """
    rows = docs.filter(F.col(lang).isNotNull()).select(F.lower(F.col(text).cast("string")).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = stage(rows.mapInArrow(_count(n), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    word = np.uint8 if len(langs) <= 8 else np.uint64
    width = 8 * np.dtype(word).itemsize
    masks = np.zeros((SLOTS, max(1, -(-len(langs) // width))), dtype=word)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= rate * F.col("total"))
    found = share.select("lang", "gram").toArrow()
    names = np.array(found["lang"].to_pylist(), dtype=object)
    grams = found["gram"].to_numpy().astype(np.int64)
    for i, name in enumerate(langs):
        for slot in _slots(grams[names == name]):
            np.bitwise_or.at(masks[:, i // width], slot, word(1 << (i % width)))
    return LanguageFilters(langs, masks, n)


def _votes(texts: pa.Array, langs: list[str], masks: np.ndarray, false_rate: np.ndarray, n: int) -> pa.Array:
    """(language, own share, lead) of each text: the corrected share of n-grams that the winner contains, and by how much it is ahead."""
    width, best_all, own_all, lead_all = _width(masks), [], [], []
    for _, part in slices(texts, SLICE):
        row, gram = _grams(part, n)
        rows = len(part)
        asked = np.bincount(row, minlength=rows)
        slots = _slots(gram)
        share = np.zeros((rows, len(langs) + 1))  # the last column is no language, so one language leads by its own share
        for word in range(masks.shape[1]):
            mask = masks[slots[0], word]
            for s in slots[1:]:
                mask = mask & masks[s, word]
            for i in range(width * word, min(len(langs), width * (word + 1))):
                hits = np.bincount(row, _has(mask, i % width), rows)
                f = false_rate[i]
                share[:, i] = np.clip((hits / np.maximum(asked, 1) - f) / max(1e-9, 1 - f), 0, 1)
        best = share[:, :-1].argmax(axis=1)
        own = share[np.arange(rows), best]
        share[np.arange(rows), best] = 0
        best_all.append(best)
        own_all.append(own)
        lead_all.append(own - share.max(axis=1))
    if not best_all:
        best_all, own_all, lead_all = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    names = pa.array(langs, pa.string()).take(pa.array(np.concatenate(best_all)))
    return pa.StructArray.from_arrays([names, pa.array(np.concatenate(own_all)), pa.array(np.concatenate(lead_all))], names=["pred", "own", "lead"])


def vote(docs: DataFrame, text: str, filters: LanguageFilters) -> Column:
    """A struct column (pred, own, lead): ``und`` and zeros for a NULL text or one without a letter.

    ``own`` is the corrected share of the text's n-grams that the predicted language contains, ``lead`` its distance to the next
    language; neither falls because more languages are learned that have other n-grams. Ties go to the least language name.
    """
    none = F.struct(F.lit("und").alias("pred"), F.lit(0.0).alias("own"), F.lit(0.0).alias("lead"))
    if not filters.langs:
        return none
    shared = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.masks, filters.false_rate, filters.n))

    def run(texts: pa.Array) -> pa.Array:
        return _votes(texts, *shared.value)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    voted = F.arrow_udf(run, "pred string, own double, lead double")(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    has_letter = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, voted).otherwise(none)


def predict_languages(docs: DataFrame, text: str, filters: LanguageFilters) -> tuple[Column, Column]:
    """(language, score) columns over ``text``: ``und`` with score 0 for a NULL text or one without a letter.

    The score is the winner's own corrected share. Without a learned language every row is ``und``.
    """
    voted = vote(docs, text, filters)
    return voted["pred"], voted["own"]


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    filters = learn_languages(docs.filter(~held), "text", "lang")
    lang, score = predict_languages(docs, "text", filters)
    return docs.select("doc_id", held.alias("held_out"), lang.alias("lang_pred"), score.alias("score"))
