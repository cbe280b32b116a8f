"""Wide, long and completed forms of panel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pick(df: DataFrame, starts: str | None = None, ends: tuple[str, ...] | str | None = None) -> list[str]:
    """Column names by prefix and/or suffix, in table order."""
    ends = (ends,) if isinstance(ends, str) else ends
    return [
        c for c in df.columns
        if (starts is None or c.startswith(starts)) and (ends is None or c.endswith(tuple(ends)))
    ]


def to_wide(df: DataFrame, ids: list[str], name: str, value: str, values: list, prefix: str = "") -> DataFrame:
    """One column per listed name. The list is explicit, so no extra job looks for it.

    Each (ids, name) cell must hold one row.
    """
    cells = [F.max(F.when(F.col(name) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in values]
    return df.groupBy(*ids).agg(*cells)


def to_long(
    df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value", prefix: str = ""
) -> DataFrame:
    """Columns to rows; ``prefix`` is cut off the names."""
    out = df.unpivot(ids, columns, name, value)
    return out.withColumn(name, F.expr(f"substring(`{name}`, {len(prefix) + 1})")) if prefix else out


def to_long_paired(df: DataFrame, ids: list[str], groups: dict[object, dict[str, str]], name: str) -> DataFrame:
    """Several value columns per name in one pass.

    ``groups`` maps a name to ``{output column: input column}``.
    """
    rows = F.array(*[
        F.struct(F.lit(key).alias(name), *[F.col(src).alias(out) for out, src in columns.items()])
        for key, columns in groups.items()
    ])
    return df.select(*ids, F.explode(rows).alias("_row")).select(*ids, "_row.*")


def unite(df: DataFrame, out: str, columns: list[str], sep: str = "_") -> DataFrame:
    """Join key columns into one name column and drop them."""
    return df.withColumn(out, F.concat_ws(sep, *columns)).drop(*[c for c in columns if c != out])


def grid(df: DataFrame, **axes: list | Column) -> DataFrame:
    """Repeat each row over the given axes: literal lists or array columns.

    The grid is made by exploding arrays row by row, so no cartesian join is planned.
    """
    for name, axis in axes.items():
        array = axis if isinstance(axis, Column) else F.array(*[F.lit(v) for v in axis])
        df = df.withColumn(name, F.explode(array))
    return df


def complete(spine: DataFrame, facts: DataFrame, keys: list[str], fill: dict[str, object] | None = None) -> DataFrame:
    """Every spine row once, with facts where they exist and ``fill`` values elsewhere."""
    out = spine.join(facts, keys, "left")
    return out.fillna(fill) if fill else out


def union_named(*frames: DataFrame, source: str | None = None, labels: list | None = None) -> DataFrame:
    """Union by column name; a missing column becomes NULL.

    With ``source``, a key column names the frame each row came from.
    """
    if source:
        labels = labels or list(range(1, len(frames) + 1))
        frames = tuple(f.withColumn(source, F.lit(label)) for f, label in zip(frames, labels, strict=True))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sum_columns(df: DataFrame, by: list[str], columns: list[str], sum_fn) -> DataFrame:
    """The same aggregate over many columns."""
    return df.groupBy(*by).agg(*[sum_fn(c).alias(c) for c in columns])
