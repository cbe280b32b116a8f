"""Report tables: availability, dispersion, distribution by region, regression input, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.functions.nulls import complete_cases, strict_sum
from panelweave.functions.text import unit_levels
from panelweave.operators.cohorts import attach, zscores
from panelweave.operators.ranks import distribution, ecdf_rank, quantiles
from panelweave.operators.shape import grid, to_long, to_wide
from panelweave.session import stage


def availability_coverage(
    dim: DataFrame, pop: DataFrame, events: DataFrame, periods: list[int], level: str, unit: str = "unit",
    period: str = "period", value: str = "pop", event: str = "events",
) -> DataFrame:
    """Units and population with and without events, per level and period, with shares.

    The unit-period spine, population and events are stacked and aggregated once, in
    place of two outer joins. A unit without population counts with 0 people.
    """
    spine = grid(dim.select(unit, level), **{period: periods}).withColumn("_in", F.lit(1))
    stacked = (
        spine.unionByName(pop.select(unit, period, F.col(value).alias("_p")), allowMissingColumns=True)
        .unionByName(events.select(unit, period, F.col(event).alias("_e")), allowMissingColumns=True)
    )
    cells = stacked.groupBy(unit, period).agg(
        F.max(level).alias(level), F.max("_in").alias("_in"), F.sum("_p").alias("_p"), F.sum("_e").alias("_e")
    ).filter("_in = 1")
    counted = cells.groupBy(level, period, F.col("_e").isNull().alias("absent")).agg(
        F.coalesce(F.sum("_p"), F.lit(0.0)).alias("pop"), F.count(F.lit(1)).alias("units")
    )
    out = attach(counted, [level, period], F.sum("pop").alias("pop_tot"), F.sum("units").alias("units_tot"))
    return out.withColumn("pop_share", F.try_divide("pop", "pop_tot")).withColumn(
        "unit_share", F.col("units") / F.col("units_tot")
    )


def availability_before_after(
    availability: DataFrame, dim: DataFrame, split: int, level: str, period: str = "period"
) -> DataFrame:
    """Mean units with events before ``split`` and from it on; levels without any show 0 of their units."""
    present = availability.filter(~F.col("absent")).groupBy(level, (F.col(period) >= split).alias("after")).agg(
        F.avg("units").alias("units")
    )
    totals = dim.groupBy(level).agg(F.count(F.lit(1)).alias("units_tot"))
    return grid(totals, after=[False, True]).join(present, [level, "after"], "left").fillna({"units": 0.0})


def dispersion_levels(
    units: DataFrame, unit_levels_: dict[str, int], small: str, large: str, region: str, period: str = "period",
    value: str = "coverage",
) -> DataFrame:
    """Spread and variance inside the small and large level, and medians of them over unit rows of the region.

    The spread of the large level also has its median over the unit rows of that level.

    ``units`` carries ``<level>_max`` and ``<level>_min`` from before the validity filter.
    """
    spreads = {f"spread_{name}": F.col(f"{name}_max") - F.col(f"{name}_min") for name in (small, large)}
    rows = units.withColumns(spreads)
    for name in (small, large):
        rows = rows.join(units.groupBy(period, name).agg(F.var_samp(value).alias(f"var_{name}")), [period, name])
    rows = stage(rows, "dispersion")
    own = quantiles(rows, f"spread_{large}", {f"spread_{large}_median": 0.5}, [large, period])
    long = to_long(rows, [region, period], [f"spread_{small}", f"var_{small}"])
    medians = quantiles(long, "value", {"median": 0.5}, [region, period, "name"]).withColumn(
        "name", F.concat("name", F.lit("_median"))
    )
    names = [f"spread_{small}_median", f"var_{small}_median"]
    wide = to_wide(medians, [region, period], "name", "median", names)
    return rows.join(wide, [region, period], "left").join(own, [large, period], "left")


def region_table(
    units: DataFrame, names: DataFrame, by: list[str], region: str = "region", value: str = "coverage", scale: float = 100.0
) -> DataFrame:
    """Distribution of the unit values per region (and what else ``by`` names) in percent, with
    sample size and region name."""
    return distribution(units, value, by, scale).join(names, region)


def scenario_table(
    grid_: DataFrame, availability: DataFrame, names: DataFrame, chosen: dict[str, str], when: int, level: tuple[str, int] = ("region", 1),
    unit: str = "unit", period: str = "period", value: str = "cov", scale: float = 100.0,
) -> DataFrame:
    """Distribution per level of one scenario and bound in one period, with the level's units that have data then as sample size.

    ``chosen`` fixes every axis of the grid, the bound included, so bounds are never pooled. Levels without a valid unit have no
    row; levels without available units have sample size 0.
    """
    missing = {"pop_source", "process", "source", "bound"} - set(chosen)
    if missing:
        raise ValueError(f"choose {', '.join(sorted(missing))} as well")
    match = F.col(period) == when
    for axis, name in chosen.items():
        match = match & (F.col(axis) == name)
    rows = unit_levels(grid_.filter(match), unit, dict([level]))
    sizes = availability.filter(~F.col("absent") & (F.col(period) == when)).select(level[0], F.col("units").alias("sample_size"))
    table = region_table(rows, names, [level[0]], level[0], value, scale)
    return table.join(sizes, level[0], "left").fillna({"sample_size": 0})


def burden_rate(
    cases: DataFrame, pop: DataFrame, years: list[int], unit: str = "unit", year: str = "year", value: str = "cases"
) -> DataFrame:
    """(unit, cases, pop, burden, burden_s): mean yearly cases per head of units with every year."""
    listed = cases.filter(F.col(year).isin(years)).groupBy(unit, year).agg(strict_sum(value).alias(value))
    whole = listed.groupBy(unit).agg(
        F.when(F.count(value) == len(years), F.sum(value)).alias("cases")
    ).filter("cases IS NOT NULL")
    rate = whole.join(pop.select(unit, "pop"), unit).filter("pop IS NOT NULL").withColumn(
        "burden", F.try_divide(F.col("cases") / len(years), F.col("pop"))
    )
    return zscores(rate, ["burden"])


def regression_frame(
    coverage: DataFrame, covariates: DataFrame, burden: DataFrame, risk: DataFrame, period: int, province: tuple[str, int],
    exclude: list[str], unit: str = "unit",
) -> DataFrame:
    """One row per unit of ``period`` with coverage by scenario, covariates, burden and risk.

    ``coverage``: unit, period, coverage_<scenario>... Covariates and risk are standardised
    over all their rows before the period is chosen.
    """
    names = [c for c in covariates.columns if c != unit]
    scaled = zscores(covariates, names)
    at_risk = zscores(complete_cases(risk), ["p_risk", "tot"])
    outcome = [c for c in coverage.columns if c.startswith("coverage")]
    valid = F.lit(True)
    for c in outcome:
        valid = valid & (F.col(c) <= 1)
    name, length = province
    joined = (
        unit_levels(coverage.filter(F.col("period") == period), unit, {name: length})
        .filter(valid & ~F.col(name).isin(exclude))
        .join(scaled, unit)
        .join(burden.select(unit, "burden", "burden_s"), unit)
        .join(at_risk.filter(F.col("period") == period), [unit, "period"])
    )
    return complete_cases(joined).distinct()


def extreme_units(
    df: DataFrame, high: str, low: str, outer: tuple[float, float] = (0.8, 0.2), inner: tuple[float, float] = (0.9, 0.1)
) -> DataFrame:
    """Rows at the top of one column and the bottom of another, with two classes of severity."""
    ranked = ecdf_rank(ecdf_rank(df, high, "rank_high"), low, "rank_low")
    strong = (F.col("rank_high") >= inner[0]) & (F.col("rank_low") <= inner[1])
    return ranked.filter((F.col("rank_high") >= outer[0]) & (F.col("rank_low") <= outer[1])).withColumn(
        "severity", F.when(strong, "inner").otherwise("outer")
    )
