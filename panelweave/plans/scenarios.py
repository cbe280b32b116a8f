"""Bounds, scenario grids and comparisons, trend shapes, projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from panelweave.operators.cohorts import running_sum
from panelweave.operators.keys import drop_violating_units
from panelweave.operators.shape import to_wide


def ageing_out_share(
    pop: DataFrame, survey: DataFrame, last_age: int, unit: str = "unit", age: str = "age", period: str = "period",
    value: str = "pop",
) -> DataFrame:
    """(unit, period, share) of events expected in the last eligible age.

    ``survey``: age, num, den. Age shares of the population times surveyed coverage,
    scaled to 1 over the surveyed ages.
    """
    rates = survey.select(F.col("age").alias(age), (F.col("num") / F.col("den")).alias("_r"))
    expected = F.col(value) * F.col("_r")
    sums = pop.join(rates, age).groupBy(unit, period).agg(
        F.sum(F.when(F.col(age) == last_age, expected)).alias("_last"), F.sum(expected).alias("_all")
    )
    return sums.select(unit, period, F.try_divide("_last", "_all").alias("share")).filter("share IS NOT NULL")


def last_age_share(
    pop: DataFrame, last_age: int, unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop"
) -> DataFrame:
    """The same share under a plain population age structure."""
    kept = pop.filter(F.col(age) <= last_age)
    last = F.sum(F.when(F.col(age) == last_age, F.col(value)))
    return kept.groupBy(unit, period).agg(F.try_divide(last, F.sum(value)).alias("share")).filter("share IS NOT NULL")


def ageing_out_bounds(
    events: DataFrame, shares: DataFrame, unit: str = "unit", period: str = "period", value: str = "events"
) -> DataFrame:
    """(source, unit, period, bound, value): cumulative events still within the eligible ages.

    With C the cumulative events and a the ageing-out share of the period before (of the
    same period for the first one): LL = C(1-a); UL = C before times (1-a) plus the new
    events, and simply C for the first period.
    """
    rows = events.select(unit, period, value).join(shares.select("source", unit, period, "share"), [unit, period])
    order = W.partitionBy(unit, "source").orderBy(period)
    rows = rows.withColumn("_c", running_sum(value, [unit, "source"], period))
    before, a = F.lag("_c").over(order), F.lag("share").over(order)
    rows = rows.withColumn("_b", before).withColumn("_a", a).withColumn("_first", F.row_number().over(order) == 1)
    low = F.when(F.col("_first"), F.col("_c") * (1 - F.col("share"))).otherwise(F.col("_c") * (1 - F.col("_a")))
    high = F.when(F.col("_first"), F.col("_c")).otherwise(
        F.col("_b") * (1 - F.col("_a")) + (F.col("_c") - F.col("_b"))
    )
    both = F.array(
        F.struct(F.lit("LL").alias("bound"), low.alias("value")), F.struct(F.lit("UL").alias("bound"), high.alias("value"))
    )
    return rows.select("source", unit, period, F.explode(both).alias("_x")).select("source", unit, period, "_x.*")


def scenario_grid(
    bounds: DataFrame, pops: DataFrame, unit: str = "unit", period: str = "period", lo: float = 0.0, hi: float = 1.0,
    drop: bool = True,
) -> DataFrame:
    """(pop_source, process, source, bound, unit, period, cov) for every combination.

    A unit with any value outside [lo, hi] is removed from all scenarios.
    """
    cov = pops.join(bounds, [unit, period]).select(
        "pop_source", "process", "source", "bound", unit, period, F.try_divide("value", "pop").alias("cov")
    )
    return drop_violating_units(cov, [unit], (F.col("cov") < lo) | (F.col("cov") > hi)) if drop else cov


def scenario_compare(df: DataFrame, axis: str, a: str, b: str, keys: list[str], value: str = "cov") -> DataFrame:
    """Two scenarios of one axis side by side per key; only keys that have both."""
    wide = to_wide(df.filter(F.col(axis).isin(a, b)), keys, axis, value, [a, b])
    return wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull())


def trend_shape(
    events: DataFrame, periods: list[int], uniform: float = 0.33, tol: float = 0.1, unit: str = "unit",
    period: str = "period", value: str = "events",
) -> DataFrame:
    """(unit, share_<period>..., tot, k, type) for units with a value in every period.

    ``k`` is the L1 distance of the shares from ``uniform``. A trend is increasing or
    stabilising if no step falls by ``tol`` or more.
    """
    wide = to_wide(events.filter(F.col(period).isin(periods)), [unit], period, value, periods, "v_")
    cells = [F.col(f"v_{p}") for p in periods]
    wide = wide.withColumn("tot", reduce(lambda x, y: x + y, cells)).filter("tot > 0")
    wide = wide.withColumns({f"share_{p}": F.col(f"v_{p}") / F.col("tot") for p in periods})
    shares = [F.col(f"share_{p}") for p in periods]
    k = reduce(lambda x, y: x + y, [F.abs(s - uniform) for s in shares])
    steps = [(y >= x) | (F.abs(y - x) < tol) for x, y in zip(shares, shares[1:])]
    kind = F.when(reduce(lambda x, y: x & y, steps), "increasing or stabilising").otherwise("other")
    return wide.withColumn("k", k).withColumn("type", kind).drop(*[f"v_{p}" for p in periods])


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Tally per key and its share of all rows; the total comes from the tally, not the rows."""
    tally = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = tally.agg(F.sum("n")).scalar()
    return tally.withColumn("tot", total).withColumn("p", F.col("n") / F.col("tot"))


def extrapolate_linear(
    df: DataFrame, target: int, unit: str = "unit", period: str = "period", value: str = "value"
) -> DataFrame:
    """(unit, fitted at ``target``, carried forward): straight line and last value per unit, one pass.

    A unit with a single period has no slope and keeps its level.
    """
    seen = df.filter(F.col(value).isNotNull())
    out = seen.groupBy(unit).agg(
        F.regr_slope(value, period).alias("_b"), F.avg(value).alias("_y"), F.avg(period).alias("_x"),
        F.max_by(value, period).alias("carried"),
    )
    fitted = F.col("_y") + F.coalesce("_b", F.lit(0.0)) * (F.lit(target) - F.col("_x"))
    return out.select(unit, F.lit(target).alias(period), fitted.alias("fitted"), "carried")
