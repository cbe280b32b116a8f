"""Window expressions over cohorts and units.

Every window here partitions by a unit (or a unit and cohort) and so spans at most as
many rows as there are periods. Totals over large groups use an aggregate and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running(keys: list[str], order: str):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def running_sum(value: str | Column, keys: list[str], order: str, strict: bool = True) -> Column:
    """Cumulative sum; with ``strict`` NULL from the first NULL on."""
    value = F.col(value) if isinstance(value, str) else value
    w = running(keys, order)
    total = F.sum(value).over(w)
    return F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), total) if strict else total


def lag_ratio(value: str, keys: list[str], order: str, default: float | None = 1.0) -> Column:
    """Value over the value of the row before it in the key; ``default`` where that gives NULL."""
    previous = F.lag(value, 1).over(W.partitionBy(*keys).orderBy(order))
    ratio = F.try_divide(F.col(value), previous)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def attach(df: DataFrame, keys: list[str], *aggs: Column, rename: dict[str, str] | None = None) -> DataFrame:
    """Group values on every row, as aggregate plus join.

    A window over these keys would put a large group into one task; the aggregate
    combines on the map side and the join can be split or broadcast at run time by
    its measured size. Rows with a NULL key form groups of their own and stay.
    """
    right = df.groupBy(*[F.col(k).alias(f"_{k}_key") for k in keys]).agg(*aggs)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}_key"))
    return df.join(right, match).drop(*[f"_{k}_key" for k in keys])


def group_share(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return attach(df, keys, F.sum(value).alias("_total")).withColumn(
        out, F.try_divide(F.col(value), F.col("_total"))
    ).drop("_total")


def zscores(df: DataFrame, columns: list[str], suffix: str = "_s") -> DataFrame:
    """(x - mean) / sd over the whole frame, through one-row subqueries instead of a window."""
    stats = [F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]
    moments = df.agg(*stats).select(F.struct(*columns).alias("_z")).scalar()
    return df.withColumn("_z", moments).withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"_z.{c}.m"), F.col(f"_z.{c}.s")) for c in columns
    }).drop("_z")
