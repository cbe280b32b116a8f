"""Population panels: harmonising sources, growth check, eligible and at-risk population."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.functions.nulls import strict_sum
from panelweave.functions.text import unit_levels
from panelweave.operators.keys import members, non_members, recode_column, recode_pairs
from panelweave.operators.ranks import quantiles
from panelweave.operators.shape import union_named
from panelweave.session import stage


def pop_harmonise(
    sources: list[DataFrame], periods: list[int], whitelist: DataFrame, pairs: DataFrame, known: DataFrame,
    unit: str = "unit", age: str = "age", period: str = "period", pop: str = "pop", level: tuple[str, int] = ("province", 2),
) -> DataFrame:
    """(unit, level, age, period, pop), complete over ``periods`` for every (unit, age) kept.

    Sources are united and restricted to whitelisted prefixes. A (code, age) with a value
    in every period is kept as it is. The others are recoded by the pair table and kept if
    the recoded code then has every period. Both parts are added up per final code.
    Completeness is judged per code, not per name, so a renamed code is not counted twice,
    and prefixes are taken after recoding.
    """
    name, length = level
    stacked = union_named(*sources).filter(F.col(period).isin(periods))
    stacked = members(stacked.withColumn(name, F.substring(unit, 1, length)), whitelist, [name])

    def wide(df: DataFrame, sum_fn) -> DataFrame:
        cells = [sum_fn(F.col(pop), F.col(period) == p).alias(f"p_{p}") for p in periods]
        return df.groupBy(unit, age).agg(*cells)

    def strict_cell(v, at):
        hit = F.count(F.when(at, F.lit(1)))
        return F.when(hit == F.count(F.when(at, v)), F.sum(F.when(at, v)))

    columns = [f"p_{p}" for p in periods]
    per_code = wide(stacked, strict_cell)
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    complete = per_code.filter(full)
    mapping = recode_pairs(pairs, known)
    recoded = recode_column(per_code.filter(~full), unit, mapping)
    recovered = recoded.groupBy(unit, age).agg(*[F.sum(c).alias(c) for c in columns]).filter(full)
    total = complete.unionByName(recovered).groupBy(unit, age).agg(*[F.sum(c).alias(c) for c in columns])
    long = total.unpivot([unit, age], columns, period, pop).withColumn(
        period, F.expr(f"substring(`{period}`, 3)").cast("int")
    )
    return unit_levels(long, unit, {name: length}).select(unit, name, age, period, pop)


def growth_ratios(pop: DataFrame, unit: str, period: str, value: str) -> DataFrame:
    """(unit, period, total, ratio to the period before, reason) in long form.

    A rise from zero has no ratio and is named by its reason instead.
    """
    totals = pop.groupBy(unit, period).agg(strict_sum(value).alias("total"))
    previous = F.lag("total").over(W.partitionBy(unit).orderBy(period))
    return totals.withColumn("previous", previous).withColumn("ratio", F.try_divide("total", "previous"))


def growth_qa(
    pop: DataFrame, unit: str = "unit", period: str = "period", value: str = "pop", lo: float = 0.75, hi: float = 1.25
) -> tuple[DataFrame, DataFrame]:
    """(panel without the offending units, offending (unit, period, ratio, reason))."""
    ratios = growth_ratios(pop, unit, period, value)
    reason = (
        F.when(F.col("ratio") > hi, "rise").when(F.col("ratio") < lo, "fall")
        .when((F.col("previous") == 0) & (F.col("total") > 0), "from_zero")
    )
    flagged = ratios.withColumn("reason", reason).filter("reason IS NOT NULL").select(unit, period, "ratio", "reason")
    return non_members(pop, flagged.select(unit).distinct(), [unit]), flagged


def eligible_population(
    pop: DataFrame, factor: dict[int, float], unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop",
) -> DataFrame:
    """(unit, period, tot, eligible, p_risk, p_risk_national).

    ``factor`` maps each eligible age to its weight. A unit-period lacking an eligible age
    has no eligible population and is left out. National totals are one small aggregate
    per period over the units that remain.
    """
    per_unit = unit_eligibility(pop, factor, unit, age, period, value).filter("eligible IS NOT NULL")
    national = per_unit.groupBy(period).agg(
        F.try_divide(strict_sum("eligible"), strict_sum("tot")).alias("p_risk_national")
    )
    return per_unit.withColumn("p_risk", F.try_divide("eligible", "tot")).join(national, period).select(
        unit, period, "tot", "eligible", "p_risk", "p_risk_national"
    )


def unit_eligibility(
    pop: DataFrame, factor: dict[int, float], unit: str, age: str, period: str, value: str
) -> DataFrame:
    """(unit, period, tot, eligible): both from one aggregate over the ages."""
    listed = F.col(age).isin(list(factor))
    weight = F.create_map(*[F.lit(x) for a, f in sorted(factor.items()) for x in (int(a), float(f))])
    # ages seen, as bits: a distinct count that combines before the shuffle
    bit = F.create_map(*[F.lit(x) for i, a in enumerate(sorted(factor)) for x in (int(a), 1 << i)])
    seen = F.bit_or(F.when(F.col(value).isNotNull(), F.try_element_at(bit, F.col(age).cast("int"))))
    whole = (seen == (1 << len(factor)) - 1) & (F.count(F.when(listed & F.col(value).isNull(), F.lit(1))) == 0)
    weighted = F.sum(F.try_element_at(weight, F.col(age).cast("int")) * F.col(value))
    return pop.groupBy(unit, period).agg(
        strict_sum(value).alias("tot"), F.when(whole, weighted).alias("eligible")
    )


def risk_population(
    pop: DataFrame, max_age: int, unit: str = "unit", age: str = "age", period: str = "period", value: str = "pop"
) -> DataFrame:
    """(unit, period, tot, at_risk, p_risk): plain sum up to ``max_age``, no age weights."""
    young = F.col(age) <= max_age
    at_risk = F.when(
        F.count(F.when(young, F.lit(1))) == F.count(F.when(young, F.col(value))), F.sum(F.when(young, F.col(value)))
    )
    return pop.groupBy(unit, period).agg(strict_sum(value).alias("tot"), at_risk.alias("at_risk")).withColumn(
        "p_risk", F.try_divide("at_risk", "tot")
    )


def covered_panel(events: DataFrame, eligible: DataFrame, unit: str = "unit", period: str = "period") -> DataFrame:
    """Events with their population; the national share covers only units with events."""
    joined = events.join(eligible.drop("p_risk_national"), [unit, period]).filter("eligible IS NOT NULL")
    joined = stage(joined, "covered")
    national = joined.groupBy(period).agg(F.try_divide(F.sum("eligible"), F.sum("tot")).alias("p_risk_national"))
    return joined.withColumn("p_risk", F.try_divide("eligible", "tot")).join(national, period)


def cohort_growth(
    pop: DataFrame, periods: list[int], max_age: int, level: str, unit: str = "unit", age: str = "age",
    period: str = "period", value: str = "pop",
) -> DataFrame:
    """(unit, level, cohort, period, rel_change, level_ratio) for cohorts seen in every period.

    Rows of one cohort and unit become columns by period, so changes need no window.
    """
    cohorts = (
        pop.filter((F.col(age) <= max_age) & F.col(period).isin(periods))
        .withColumn("cohort", F.col(period) - F.col(age))
        .groupBy(unit, level, "cohort")
        .agg(*[F.sum(F.when(F.col(period) == p, F.col(value))).alias(f"p_{p}") for p in periods])
    )
    sums = cohorts.groupBy(level, "cohort").agg(*[strict_sum(f"p_{p}").alias(f"s_{p}") for p in periods])
    joined = cohorts.join(sums, [level, "cohort"])
    changes = [
        F.struct(
            F.lit(b).alias(period),
            (F.try_divide(f"p_{b}", f"p_{a}") - 1).alias("rel_change"),
            F.try_divide(f"s_{b}", f"s_{a}").alias("level_ratio"),
        )
        for a, b in zip(periods, periods[1:])
    ]
    rows = joined.withColumn("_r", F.array(*changes))
    whole = F.forall("_r", lambda r: r["rel_change"].isNotNull() & r["level_ratio"].isNotNull())
    return rows.filter(whole).select(unit, level, "cohort", F.explode("_r").alias("_r")).select(
        unit, level, "cohort", "_r.*"
    )


def cohort_growth_windows(
    pop: DataFrame, periods: list[int], width: int, max_age: int, level: str, unit: str = "unit", age: str = "age",
    period: str = "period", value: str = "pop",
) -> DataFrame:
    """``cohort_growth`` in every window of ``width`` consecutive entries of ``periods``, with the window's first period as ``window``.

    Which periods a cohort of a unit has is a bit mask. A window is complete for it if all bits of the window are set; where only some
    are, the sums of its level are not complete in that window, and one bitwise OR over the units says so for all windows at once. Sums and
    changes are made once for all windows. At most 62 periods.
    """
    if not 1 < width <= len(periods) <= 62:
        raise ValueError("a window has two periods at least and the list 62 at most")
    at = range(len(periods))
    cohorts = (
        pop.filter((F.col(age) <= max_age) & F.col(period).isin(periods))
        .withColumn("cohort", F.col(period) - F.col(age))
        .groupBy(unit, level, "cohort")
        .agg(*[F.sum(F.when(F.col(period) == p, F.col(value))).alias(f"p_{i}") for i, p in enumerate(periods)])
    )
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"p_{i}").isNotNull(), F.lit(1 << i)).otherwise(0).cast("long") for i in at])
    starts = range(len(periods) - width + 1)

    def windows(test) -> Column:
        """Bit s is set where the test holds for the present bits of the window that starts at s."""
        full = (1 << width) - 1
        found = [F.when(test(F.col("_has").bitwiseAND(F.lit(full << s)), full << s), F.lit(1 << s)).otherwise(0).cast("long") for s in starts]
        return reduce(lambda a, b: a.bitwiseOR(b), found)

    cohorts = cohorts.withColumn("_has", bits)
    cohorts = cohorts.withColumns({"_whole": windows(lambda has, full: has == full), "_part": windows(lambda has, full: (has != 0) & (has != full))})
    sums = cohorts.groupBy(level, "cohort").agg(*[F.sum(f"p_{i}").alias(f"s_{i}") for i in at], F.bit_or("_part").alias("_gaps"))
    joined = cohorts.filter("_whole <> 0").join(sums, [level, "cohort"])
    steps = F.array(*[
        F.struct(
            F.lit(periods[i + 1]).alias(period), (F.try_divide(f"p_{i + 1}", f"p_{i}") - 1).alias("rel_change"),
            F.try_divide(f"s_{i + 1}", f"s_{i}").alias("level_ratio"))
        for i in at[:-1]
    ])
    open_at = F.col("_whole").bitwiseAND(F.bitwise_not("_gaps"))
    chosen = F.filter(
        F.array(*[F.struct(F.lit(periods[s]).alias("window"), F.slice("_steps", s + 1, width - 1).alias("r"), F.lit(1 << s).cast("long").alias("bit")) for s in starts]),
        lambda w: (open_at.bitwiseAND(w["bit"]) != 0) & F.forall(w["r"], lambda r: r["rel_change"].isNotNull() & r["level_ratio"].isNotNull()))
    rows = joined.withColumn("_steps", steps).select(unit, level, "cohort", F.explode(chosen).alias("_w"))
    return rows.select(unit, level, "cohort", "_w.window", F.explode("_w.r").alias("_r")).select(unit, level, "cohort", "window", "_r.*")


def cohort_growth_summary(growth: DataFrame, level: str, period: str = "period") -> DataFrame:
    """Quartiles of the relative change per level, cohort and period, and per window where there are several."""
    window = ["window"] if "window" in growth.columns else []
    return quantiles(growth, "rel_change", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, [level, "cohort", *window, period])
