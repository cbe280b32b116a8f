"""Null rules of the panel model.

``strict_*`` aggregates are NULL as soon as one input is NULL; the built-in
aggregates ignore NULLs and stand for the lenient form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def strict(aggregate: Column, value: str | Column) -> Column:
    """``aggregate`` of ``value``, or NULL when the group holds a NULL value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def strict_sum(value: str | Column) -> Column:
    return strict(F.sum(value), value)


def strict_avg(value: str | Column) -> Column:
    return strict(F.avg(value), value)


def strict_max(value: str | Column) -> Column:
    return strict(F.max(value), value)


def zero_sum(value: str | Column) -> Column:
    """Lenient sum whose empty case is 0 instead of NULL."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Quotient that is NULL, not an error, for a zero or NULL denominator."""
    return F.try_divide(num, den)


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def complete_cases(df: DataFrame, columns: list[str] | None = None, keep: str = "complete") -> DataFrame:
    """Rows without any NULL, or with ``keep="incomplete"`` the other rows."""
    columns = columns or df.columns
    if keep == "complete":
        return df.dropna("any", subset=columns)
    if keep == "incomplete":
        return df.filter(any_null(columns))
    raise ValueError(f"keep must be 'complete' or 'incomplete', not {keep!r}")
