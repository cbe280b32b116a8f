"""Allocation of events to ages and cumulative cohort coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelweave.functions.text import unit_levels
from panelweave.operators.cohorts import lag_ratio, running_sum


def alloc_weights_survey(
    pop: DataFrame, survey: DataFrame, unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop"
) -> DataFrame:
    """(scenario, age, weight): reference unit's ages times surveyed coverage, scaled to sum 1.

    ``survey``: scenario, ref_unit, ref_period, age, num, den. The reference units are
    picked by a join, so the filter reaches the population scan.
    """
    reference = survey.select(
        "scenario", F.col("ref_unit").alias(unit), F.col("ref_period").alias(period), F.col("age").alias(age),
        (F.col("num") / F.col("den")).alias("_share"),
    )
    covered = (
        pop.join(reference, [unit, period, age])
        .groupBy("scenario", age).agg(F.sum(F.col(value) * F.col("_share")).alias("_c"))
    )
    # one row per age, so the window over a scenario spans at most the surveyed ages
    total = F.sum("_c").over(W.partitionBy("scenario"))
    return covered.select("scenario", age, F.try_divide("_c", total).alias("weight"))


def alloc_weights_population(
    pop: DataFrame, factor: dict[int, float], unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop"
) -> DataFrame:
    """(unit, period, age, pop, factor, eligible, weight): weighted age population over the eligible sum."""
    cells = _age_cells(pop, None, factor, unit, age, period, value, "events")
    return _age_rows(cells, factor, age, value).select(
        unit, period, age, value, "factor", "eligible",
        F.try_divide(F.col("factor") * F.col(value), F.col("eligible")).alias("weight"),
    )


def _age_cells(pop, events, factor, unit, age, period, value, event) -> DataFrame:
    """One row per (unit, period): population by age, eligible sum and events.

    Both inputs are stacked and combined on the map side per (unit, period), so repeated rows
    of one unit never meet in one task. The cells, at most one per period of a unit, are then
    hashed by unit; the cohort windows and coverage sums partition by keys that contain the
    unit and need no further shuffle.
    """
    stacked = pop.filter(F.col(age).isin(list(factor))).select(
        unit, period, F.col(age).cast("int").alias(age), F.col(value).alias(value)
    )
    if events is not None:
        stacked = stacked.unionByName(events.select(unit, period, F.col(event).alias(event)), allowMissingColumns=True)
    by_age = []
    for a in sorted(factor):
        hit = F.col(age) == a
        by_age.append(F.when(F.count(F.when(hit, F.lit(1))) == F.count(F.when(hit, F.col(value))),
                             F.sum(F.when(hit, F.col(value)))).alias(f"_p{a}"))
    aggs = [*by_age]
    if events is not None:
        aggs.append(F.sum(event).alias(event))
    cells = stacked.groupBy(unit, period).agg(*aggs)
    eligible = sum((F.col(f"_p{a}") * float(f) for a, f in sorted(factor.items())), F.lit(0.0))
    return cells.withColumn("eligible", eligible).filter("eligible IS NOT NULL").repartition(F.col(unit))


def _age_rows(cells: DataFrame, factor: dict[int, float], age: str, value: str) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(a).alias(age), F.lit(float(f)).alias("factor"), F.col(f"_p{a}").alias(value))
        for a, f in sorted(factor.items())
    ])
    keep = [c for c in cells.columns if not c.startswith("_p")]
    return cells.select(*keep, F.explode(rows).alias("_a")).select(*keep, "_a.*")


def cohort_coverage(
    events: DataFrame, pop: DataFrame, factor: dict[int, float], periods: list[int], weights: DataFrame | None = None,
    unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop", event: str = "events",
    baseline: str = "pop",
) -> DataFrame:
    """Coverage by scenario, unit, period and age.

    Columns: scenario, unit, period, age, cohort, pop, factor, weight, doses, doses_cum, ratio,
    doses_adj, age_coverage, covered, eligible_pop, coverage. ``coverage`` divides the
    unadjusted cumulative events of the eligible cohorts by the factor-weighted population.
    ``weights`` (scenario, age, weight) adds scenarios next to the population-weighted one.
    """
    ages = sorted(factor)
    cells = _age_cells(pop.filter(F.col(period).isin(periods)), events.filter(F.col(period).isin(periods)),
                       factor, unit, age, period, value, event).filter(F.col(event).isNotNull())
    rows = _age_rows(cells, factor, age, value)
    own = F.array(F.struct(
        F.lit(baseline).alias("scenario"),
        F.try_divide(F.col("factor") * F.col(value), F.col("eligible")).alias("weight"),
    ))
    if weights is not None:
        # at most one row per listed age, so the broadcast cannot grow with the data
        per_age = weights.filter(F.col(age).isin(ages)).groupBy(age).agg(
            F.sort_array(F.collect_list(F.struct("scenario", "weight"))).alias("_w")
        )
        rows = rows.join(F.broadcast(per_age), age, "left")
        own = F.concat(own, F.coalesce("_w", F.array().cast("array<struct<scenario:string,weight:double>>")))
    rows = rows.withColumn("_s", F.explode(own)).select(
        F.col("_s.scenario").alias("scenario"), unit, period, age, (F.col(period) - F.col(age)).alias("cohort"),
        value, "factor", F.col("_s.weight").alias("weight"), (F.col(event) * F.col("_s.weight")).alias("doses"),
    )
    key = [unit, "scenario", "cohort"]
    rows = rows.withColumns({"doses_cum": running_sum("doses", key, period), "ratio": lag_ratio(value, key, period)})
    adjusted = F.col("ratio") * F.col("doses_cum")
    rows = rows.withColumns({"doses_adj": adjusted, "age_coverage": F.try_divide(adjusted, F.col(value))})
    rows = eligible_cohorts(rows, period, max(ages))
    cell = W.partitionBy(unit, "scenario", period)
    covered = F.when(F.count("doses_cum").over(cell) == F.count(F.lit(1)).over(cell), F.sum("doses_cum").over(cell))
    people = F.sum(F.col("factor") * F.col(value)).over(cell)
    return rows.withColumns({"covered": covered, "eligible_pop": people}).withColumn(
        "coverage", F.try_divide("covered", "eligible_pop")
    )


def eligible_cohorts(df: DataFrame, period: str, max_age: int, cohort: str = "cohort") -> DataFrame:
    """Rows whose cohort is 0 to ``max_age`` periods old in the row's period."""
    return df.filter(F.col(cohort).between(F.col(period) - max_age, F.col(period)))


def unit_coverage(cov: DataFrame, unit: str = "unit", period: str = "period") -> DataFrame:
    """One row per scenario, unit and period."""
    return cov.groupBy(unit, "scenario", period).agg(
        F.max("covered").alias("covered"), F.max("eligible_pop").alias("eligible_pop"), F.max("coverage").alias("coverage")
    )


def level_extremes(
    units: DataFrame, levels: dict[str, int], unit: str = "unit", period: str = "period", value: str = "coverage"
) -> DataFrame:
    """Add ``<level>_max`` and ``<level>_min`` of the unit values, NULLs ignored.

    Extremes are combined on the map side per prefix and period and joined back, so a
    prefix that holds most units is never gathered in one window.
    """
    base = unit_levels(units, unit, levels)
    keys = [c for c in ("scenario", period) if c in units.columns]
    out = base
    for name in levels:
        ends = base.groupBy(name, *keys).agg(F.max(value).alias(f"{name}_max"), F.min(value).alias(f"{name}_min"))
        out = out.join(ends, [name, *keys])
    return out


def valid_units(units: DataFrame, unit: str = "unit", period: str = "period", top: float = 1.0) -> DataFrame:
    """Unit-periods whose coverage does not pass ``top`` in any scenario."""
    bad = units.groupBy(unit, period).agg(F.max("coverage").alias("_hi"), F.count("coverage").alias("_n"),
                                          F.count(F.lit(1)).alias("_rows"))
    good = bad.filter((F.col("_hi") <= top) & (F.col("_n") == F.col("_rows"))).select(unit, period)
    return units.join(good, [unit, period], "left_semi")
