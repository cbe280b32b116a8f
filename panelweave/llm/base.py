"""Shared pieces: words, folds, Arrow text slices, shingle hashes and tallies.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. Lower-casing is of A-Z only. A NULL text is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of an ASCII text, which DuckDB has no function for."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: {bits}), 4294967295)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), lambda w: w != "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Hand free memory back: workers stay alive between stages, and what Arrow and malloc keep in reserve would add to the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def slices(texts: pa.Array, size: int = SLICE, rows: int = 2048):
    """(first row, string array without NULLs) parts of about ``size`` bytes and ``rows`` rows at most; a longer text is a part of its own."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))))
        yield at, texts.slice(at, to - at)
        at = to
    give_back()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and the end)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def byte_grams(texts: pa.Array, order: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of each byte and of one end symbol, with the ``order`` bytes before it as the high bytes of the gram."""
    raw, at = buffers(texts)
    sizes = np.diff(at)
    rows = len(sizes)
    pad = order + 1
    line = np.full(len(raw) + rows * pad, start, dtype=np.uint8)
    shift = np.repeat(np.arange(rows) * pad + order, sizes)
    line[np.arange(len(raw)) + shift] = raw
    line[at[1:] + np.arange(1, rows + 1) * pad - 1] = end
    gram = np.zeros(len(line) - order, dtype=np.int64) if len(line) else np.zeros(0, np.int64)
    for i in range(order + 1):
        gram <<= 8
        gram |= line[i : len(line) - order + i]
    # the windows that end on a start byte are dropped
    row = np.repeat(np.arange(rows), sizes + pad)[order:]
    first = at[:-1] + np.arange(rows) * pad
    inner = np.ones(len(gram), dtype=bool)
    for i in range(order):
        starts = first + i - order
        inner[starts[starts >= 0]] = False
    return row[inner], gram[inner]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of each word in order, and the distinct words by code; the texts are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = pc.filter(flat, real).dictionary_encode()
    row = pc.filter(row, real).to_numpy(zero_copy_only=False).astype(np.int64)
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit value spread over the whole word (a multiply-xorshift round)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each run of ``width`` words; a shorter text has one shingle of all its words, an empty one none."""
    row, code, words = word_codes(texts)
    value = mixed(word_hashes(words))[code]
    prime = np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount(row, minlength=len(texts))
    first = np.cumsum(counts) - counts
    rows, hashes = [], []
    for n in range(1, width + 1):
        if n < width:
            start = first[counts == n]
        else:
            start = np.flatnonzero(np.arange(len(row)) + width <= (first + counts)[row]) if len(row) else row
        if not len(start):
            continue
        h = np.full(len(start), n, dtype=np.uint64)
        for i in range(n):
            h = h * prime + value[start + i]
        rows.append(row[start])
        hashes.append(mixed(h))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def spread(df: DataFrame, rows: int = 16_384) -> DataFrame:
    """A written table dealt evenly in tasks of about ``rows`` rows, for steps that make many rows of each."""
    return df.repartition(max(1, -(-df.count() // rows)))


class Tally:
    """Sums per key inside one task; hands its table out when it has more than ``limit`` keys."""

    def __init__(self, key: str, limit: int = 1_000_000):
        self.key, self.limit, self.parts, self.rows = key, limit, [], 0

    def add(self, part: pa.Table):
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > 2 * self.limit:
            self._merge()
            if self.rows > self.limit:
                yield from self.take()

    def _merge(self):
        whole = pa.concat_tables(self.parts)
        sums = [c for c in whole.column_names if c != self.key]
        grouped = whole.group_by(self.key).aggregate([(c, "sum") for c in sums])
        self.parts = [grouped.select([self.key, *[f"{c}_sum" for c in sums]]).rename_columns([self.key, *sums])]
        self.rows = len(grouped)

    def take(self):
        if self.parts:
            self._merge()
            yield from self.parts[0].to_batches(max_chunksize=200_000)
        self.parts, self.rows = [], 0


def frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, ``limit`` at most: whole classes of log2(count) in quarter steps.

    The histogram has a few hundred rows whatever the data, so the bound on the result is proven.
    """
    step = F.floor(F.log2(F.col(count)) * 4)
    classes = df.filter(F.col(count) > 0).groupBy(step.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["n"]
        if total > limit:
            break
        least = r["c"]
    return df.filter(F.lit(False) if least is None else (F.col(count) > 0) & (step >= least))
