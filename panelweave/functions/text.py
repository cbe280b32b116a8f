"""Unit codes, numbers inside text, and name parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMBER_PATTERN = r"(-?[0-9]+(?:\.[0-9]+)?)"
ASCII_RUN = r"[\x01-\x7F]+"
SEPARATOR = r"[^A-Za-z0-9]+"


def unit_levels(df: DataFrame, code: str, lengths: dict[str, int]) -> DataFrame:
    """Add one prefix column per level, e.g. ``{"province": 2, "prefecture": 4}``."""
    return df.withColumns({name: F.substring(code, 1, n) for name, n in lengths.items()})


def code_segment(code: str | Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``, both counted from 1 and included."""
    return F.substring(code, start, end - start + 1)


def parse_number(text: str | Column) -> Column:
    """First number in a text, thousands separators removed; NULL if there is none."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.regexp_extract(plain, NUMBER_PATTERN, 1).try_cast("double")


def strip_digits(text: str | Column) -> Column:
    return F.regexp_replace(text, "[0-9]", "")


def strip_ascii(text: str | Column) -> Column:
    """Drop ASCII runs, which leaves the local-script part of a mixed name."""
    return F.regexp_replace(text, ASCII_RUN, "")


def first_word(text: str | Column) -> Column:
    return F.substring_index(text, " ", 1)


def split_parts(df: DataFrame, text: str, into: list[str | None], sep: str = SEPARATOR) -> DataFrame:
    """Split ``text`` into named columns; a ``None`` name drops that part.

    A text with fewer parts leaves the missing ones NULL.
    """
    parts = F.split(F.col(text), sep)
    new = {name: F.get(parts, F.lit(i)) for i, name in enumerate(into) if name}
    return df.withColumns(new).drop(*([] if text in new else [text]))
