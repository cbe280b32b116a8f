"""A set of keys as a bitmap of fixed size, to keep most rows out of a shuffle.

The bitmap has 2^27 bits, 16 MB, whatever the data, so it may be broadcast. It never loses a
key; other keys may pass, so a join or an exact check follows. When the set outgrows it, more
rows pass and the result stays the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import free_name
from panelweave.session import stage

BITS, BLOCK = 27, 15  # a block is what bitmap_construct_agg makes: 2^15 bits


def _place(key: Column) -> tuple[Column, Column]:
    """Block and bit of a 64-bit hash."""
    h = key.bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftright(h, BLOCK), h.bitwiseAND(F.lit((1 << BLOCK) - 1))


def key_filter(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(block, one bitmap per name) of the 64-bit hashes in ``keys``; NULLs are left out."""
    aggs, entries = [], []
    for i, key in enumerate(keys.values()):
        block, at = _place(key)
        entries.append(F.when(key.isNotNull(), F.struct(block.alias("block"), at.alias("at"), F.lit(i).alias("set"))))
    for i, name in enumerate(keys):
        aggs.append(F.expr(f"bitmap_construct_agg(CASE WHEN set = {i} THEN at END)").alias(name))
    rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*").distinct()
    return stage(rows.groupBy("block").agg(*aggs), "keys")


def may_have(df: DataFrame, keys: DataFrame, key: Column, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with bitmaps attached, and a boolean column per name; drop the attached columns by selecting after use."""
    block, at = _place(key)
    own = {c: free_name(df, f"_{c}") for c in ["block", *names]}
    small = keys.select(*[F.col(c).alias(own[c]) for c in own])
    joined = df.join(F.broadcast(small), block == F.col(own["block"]), "left")
    byte = (F.shiftright(at, 3) + 1).cast("int")

    def has(name: str) -> Column:
        cell = F.conv(F.hex(F.substring(F.col(own[name]), byte, F.lit(1))), 16, 10).cast("int")
        bit = F.pow(F.lit(2), at.bitwiseAND(F.lit(7))).cast("int")
        return F.coalesce(cell.bitwiseAND(bit) > 0, F.lit(False))

    return joined, {n: has(n) for n in names}


def rows_with_keys(df: DataFrame, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """The rows of ``df`` whose key is in the named set, and some others."""
    joined, has = may_have(df, keys, key, [name])
    return joined.filter(has[name]).select(*[F.col(f"`{c}`") for c in df.columns])


def split_by_keys(df: DataFrame, keys: DataFrame, key: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of the set, rows that surely have none); a NULL key is in the second part."""
    joined, has = may_have(df, keys, key, [name])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return joined.filter(has[name]).select(*columns), joined.filter(~has[name]).select(*columns)


def as_array(keys: DataFrame, name: str) -> np.ndarray:
    """The named set as 2^24 bytes, for ``np_has``."""
    bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for r in keys.select("block", name).toLocalIterator():
        part = np.frombuffer(r[name], dtype=np.uint8)
        bits[r["block"] << (BLOCK - 3) : (r["block"] + 1) << (BLOCK - 3)] = part
    return bits


def np_has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit of each place (a hash, of which the low 27 bits count) is set."""
    low = places & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0
