"""Composite panel pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.text import unit_levels
from panelweave.plans import coverage as C, population as P, reports as R
from panelweave.session import stage
from workload import views as V
from workload.registry import FACTOR, LEVELS, PERIODS, SPAN, query, rd, rounded

@query("eligible_population", f"""
SELECT unit, period, tot, eligible, {rd('eligible / tot')} AS p_risk,
       {rd('sum(eligible) OVER (PARTITION BY period) / sum(tot) OVER (PARTITION BY period)')} AS p_risk_national
FROM v_elig WHERE eligible IS NOT NULL""")
def eligible_population(spark, sf):
    return rounded(P.eligible_population(V.pop(spark, sf), FACTOR))


@query("risk_population", f"""
SELECT unit, period, sum(pop) AS tot, sum(CASE WHEN age <= 5 THEN pop END) AS at_risk,
       {rd('sum(CASE WHEN age <= 5 THEN pop END) / sum(pop)')} AS p_risk
FROM v_pop GROUP BY unit, period""")
def risk_population(spark, sf):
    return rounded(P.risk_population(V.pop(spark, sf), 5))


@query("covered_panel", f"""
SELECT unit, period, events, tot, eligible, {rd('eligible / tot')} AS p_risk,
       {rd('sum(eligible) OVER (PARTITION BY period) / sum(tot) OVER (PARTITION BY period)')} AS p_risk_national
FROM v_event JOIN v_elig USING (unit, period) WHERE eligible IS NOT NULL""")
def covered_panel(spark, sf):
    elig = P.eligible_population(V.pop(spark, sf), FACTOR)
    return rounded(P.covered_panel(V.event(spark, sf), elig).select(
        "unit", "period", "events", "tot", "eligible", "p_risk", "p_risk_national"
    ))


@query("alloc_weights_survey", f"SELECT scenario, CAST(age AS INTEGER) AS age, {rd('weight')} AS weight FROM v_weight")
def alloc_weights_survey(spark, sf):
    return rounded(V.weights(spark, sf))


@query("alloc_weights_population", f"""
SELECT unit, period, age, pop, factor, {rd('weight')} AS weight FROM (
  SELECT p.unit, p.period, p.age, p.pop, CAST(CASE WHEN p.age = 0 THEN 0.5 ELSE 1 END AS DOUBLE) AS factor,
         CASE WHEN p.age = 0 THEN 0.5 ELSE 1 END * p.pop / e.eligible AS weight
  FROM v_pop p JOIN v_elig e USING (unit, period) WHERE p.age <= 5 AND e.eligible IS NOT NULL)""")
def alloc_weights_population(spark, sf):
    return rounded(C.alloc_weights_population(V.pop(spark, sf), FACTOR).drop("eligible"))


@query("cohort_coverage", f"""
SELECT scenario, c.unit, c.period, age, cohort, {rd('weight')} AS weight, {rd('doses')} AS doses,
       {rd('doses_cum')} AS doses_cum, {rd('doses_adj')} AS doses_adj, {rd('age_coverage')} AS age_coverage,
       {rd('coverage')} AS coverage, {rd('prefecture_max')} AS prefecture_max, {rd('prefecture_min')} AS prefecture_min,
       {rd('province_max')} AS province_max, {rd('province_min')} AS province_min
FROM v_cov c JOIN (
  SELECT scenario, unit, period, max(coverage) OVER f AS prefecture_max, min(coverage) OVER f AS prefecture_min,
         max(coverage) OVER v AS province_max, min(coverage) OVER v AS province_min
  FROM v_unitcov WINDOW f AS (PARTITION BY scenario, prefecture, period), v AS (PARTITION BY scenario, province, period)
) USING (scenario, unit, period)""")
def cohort_coverage(spark, sf):
    cov = stage(V.coverage(spark, sf), "coverage")
    ends = C.level_extremes(C.unit_coverage(cov), {k: LEVELS[k] for k in ("prefecture", "province")})
    ends = ends.select("scenario", "unit", "period", "prefecture_max", "prefecture_min", "province_max", "province_min")
    out = cov.select("scenario", "unit", "period", "age", "cohort", "weight", "doses", "doses_cum", "doses_adj",
                     "age_coverage", "coverage")
    return rounded(out.join(ends, ["scenario", "unit", "period"]))


@query("growth_qa", f"""
WITH t AS (SELECT unit, period, sum(pop) AS total FROM v_pop WHERE period {SPAN} GROUP BY 1, 2),
r AS (SELECT *, lag(total) OVER (PARTITION BY unit ORDER BY period) AS previous FROM t),
bad AS (SELECT DISTINCT unit FROM r WHERE total / nullif(previous, 0) > 1.25 OR total / nullif(previous, 0) < 0.75
        OR (previous = 0 AND total > 0))
SELECT unit, age, period, pop FROM v_pop WHERE period {SPAN} AND unit NOT IN (SELECT unit FROM bad)""")
def growth_qa(spark, sf):
    panel = V.pop(spark, sf).filter(F.col("period").isin(PERIODS))
    return P.growth_qa(panel)[0]


@query("growth_qa_flagged", f"""
WITH t AS (SELECT unit, period, sum(pop) AS total FROM v_pop WHERE period {SPAN} GROUP BY 1, 2),
r AS (SELECT *, lag(total) OVER (PARTITION BY unit ORDER BY period) AS previous FROM t)
SELECT unit, period, {rd('total / previous')} AS ratio, CASE WHEN total / previous > 1.25 THEN 'rise' ELSE 'fall' END AS reason
FROM r WHERE total / previous > 1.25 OR total / previous < 0.75""")
def growth_qa_flagged(spark, sf):
    panel = V.pop(spark, sf).filter(F.col("period").isin(PERIODS))
    return rounded(P.growth_qa(panel)[1])


# a cohort is complete over at most max_age + 1 periods, so its growth is followed over moving windows
WIDTH = 4
STARTS = PERIODS[: len(PERIODS) - WIDTH + 1]
GROWTH_SQL = f"""
w AS (SELECT CAST(unnest({STARTS}) AS INTEGER) AS "window"),
c AS (
  SELECT "window", unit, substr(unit, 1, 3) AS province, period - age AS cohort,
         sum(CASE WHEN period = "window" THEN pop END) AS p6, sum(CASE WHEN period = "window" + 1 THEN pop END) AS p7,
         sum(CASE WHEN period = "window" + 2 THEN pop END) AS p8, sum(CASE WHEN period = "window" + 3 THEN pop END) AS p9
  FROM v_pop JOIN w ON period BETWEEN "window" AND "window" + 3 WHERE age <= 5 GROUP BY 1, 2, 3, 4),
s AS (
  SELECT "window", province, cohort,
         CASE WHEN count(p6) = count(*) THEN sum(p6) END AS s6, CASE WHEN count(p7) = count(*) THEN sum(p7) END AS s7,
         CASE WHEN count(p8) = count(*) THEN sum(p8) END AS s8, CASE WHEN count(p9) = count(*) THEN sum(p9) END AS s9
  FROM c GROUP BY 1, 2, 3),
j AS (SELECT * FROM c JOIN s USING ("window", province, cohort) WHERE p6 * p7 * p8 * p9 IS NOT NULL AND s6 * s7 * s8 * s9 IS NOT NULL),
g AS (SELECT unit, province, cohort, "window", "window" + 1 AS period, p7 / p6 - 1 AS rel_change, s7 / s6 AS level_ratio FROM j
UNION ALL SELECT unit, province, cohort, "window", "window" + 2, p8 / p7 - 1, s8 / s7 FROM j
UNION ALL SELECT unit, province, cohort, "window", "window" + 3, p9 / p8 - 1, s9 / s8 FROM j)"""


def _growth(spark, sf):
    panel = unit_levels(V.pop(spark, sf), "unit", {"province": 3})
    return P.cohort_growth_windows(panel, PERIODS, WIDTH, 5, "province")


@query("cohort_growth", f"""
WITH {GROWTH_SQL}
SELECT unit, province, cohort, "window", period, {rd('rel_change')} AS rel_change, {rd('level_ratio')} AS level_ratio FROM g""")
def cohort_growth(spark, sf):
    return rounded(_growth(spark, sf))


@query("cohort_growth_summary", f"""
WITH {GROWTH_SQL}
SELECT province, cohort, "window", period, {rd('quantile_cont(rel_change, 0.25)')} AS q1, {rd('median(rel_change)')} AS q2,
       {rd('quantile_cont(rel_change, 0.75)')} AS q3 FROM g GROUP BY 1, 2, 3, 4""")
def cohort_growth_summary(spark, sf):
    return rounded(P.cohort_growth_summary(_growth(spark, sf), "province"))


@query("availability_coverage", f"""
WITH spine AS (SELECT unit, substr(unit, 1, 1) AS region, CAST(period AS INTEGER) AS period
               FROM v_unit, range({PERIODS[0]}, {PERIODS[-1] + 1}) p(period)),
ev AS (SELECT unit, period, events FROM v_event WHERE NOT (substr(unit, 1, 1) = '2' AND period = 1999)
       AND NOT (substr(unit, 4, 1) = '1' AND period = 1997)),
c AS (SELECT s.unit, region, s.period, p.pop, e.events IS NULL AS absent FROM spine s
      LEFT JOIN (SELECT unit, period, sum(pop) AS pop FROM v_pop GROUP BY 1, 2) p USING (unit, period)
      LEFT JOIN ev e USING (unit, period)),
g AS (SELECT region, period, absent, coalesce(sum(pop), 0) AS pop, count(*) AS units FROM c GROUP BY 1, 2, 3)
SELECT region, period, absent, pop, units, sum(pop) OVER w AS pop_tot, CAST(sum(units) OVER w AS BIGINT) AS units_tot,
       {rd('pop / sum(pop) OVER w')} AS pop_share, {rd('units / sum(units) OVER w')} AS unit_share
FROM g WINDOW w AS (PARTITION BY region, period)""")
def availability_coverage(spark, sf):
    return rounded(_availability(spark, sf))


def _gappy_events(spark, sf):
    """Events with a region missing in the last period and a prefecture class missing in another."""
    ev = V.event(spark, sf)
    return ev.filter(
        ~((F.substring("unit", 1, 1) == "2") & (F.col("period") == 1999))
        & ~((F.substring("unit", 4, 1) == "1") & (F.col("period") == 1997))
    )


def _availability(spark, sf):
    dim = unit_levels(V.units(spark, sf), "unit", {"region": 1})
    return R.availability_coverage(dim, V.pop(spark, sf), _gappy_events(spark, sf), PERIODS, "region")


@query("dim_complete_zero", f"""
WITH spine AS (SELECT unit, substr(unit, 1, 1) AS region, CAST(period AS INTEGER) AS period
               FROM v_unit, range({PERIODS[0]}, {PERIODS[-1] + 1}) p(period)),
ev AS (SELECT unit, period, events FROM v_event WHERE NOT (substr(unit, 1, 1) = '2' AND period = 1999)
       AND NOT (substr(unit, 4, 1) = '1' AND period = 1997)),
g AS (SELECT region, period, count(*) AS units FROM spine JOIN ev USING (unit, period) GROUP BY 1, 2),
p AS (SELECT region, period >= 1999 AS after, avg(units) AS units FROM g GROUP BY 1, 2),
t AS (SELECT substr(unit, 1, 1) AS region, count(*) AS units_tot FROM v_unit GROUP BY 1)
SELECT region, units_tot, after, {rd('coalesce(units, 0)')} AS units
FROM t CROSS JOIN (VALUES (false), (true)) a(after) LEFT JOIN p USING (region, after)""")
def dim_complete_zero(spark, sf):
    dim = unit_levels(V.units(spark, sf), "unit", {"region": 1})
    return rounded(R.availability_before_after(_availability(spark, sf), dim, 1999, "region"))


DISPERSION_SQL = f"""
WITH e AS (
  SELECT *, max(coverage) OVER f - min(coverage) OVER f AS spread_prefecture,
         max(coverage) OVER v - min(coverage) OVER v AS spread_province
  FROM v_unitcov WINDOW f AS (PARTITION BY scenario, prefecture, period), v AS (PARTITION BY scenario, province, period)),
k AS (SELECT e.* FROM e JOIN v_valid USING (unit, period) WHERE scenario = 'pop'),
d AS (SELECT *, var_samp(coverage) OVER (PARTITION BY period, prefecture) AS var_prefecture,
             var_samp(coverage) OVER (PARTITION BY period, province) AS var_province FROM k)
"""


@query("dispersion_levels", DISPERSION_SQL + f"""
SELECT unit, period, {rd('spread_prefecture')} AS spread_prefecture, {rd('spread_province')} AS spread_province,
       {rd('var_prefecture', 9)} AS var_prefecture, {rd('var_province', 9)} AS var_province,
       {rd('median(spread_prefecture) OVER (PARTITION BY region, period)')} AS spread_prefecture_median,
       {rd('median(spread_province) OVER (PARTITION BY province, period)')} AS spread_province_median,
       {rd('median(var_prefecture) OVER (PARTITION BY region, period)', 9)} AS var_prefecture_median
FROM d""")
def dispersion_levels(spark, sf):
    rows = _dispersion(spark, sf)
    spread = ["spread_prefecture", "spread_province", "spread_prefecture_median", "spread_province_median"]
    var = ["var_prefecture", "var_province", "var_prefecture_median"]
    return rows.select(
        "unit", "period", *[(F.round(c, 6) + 0.0).alias(c) for c in spread], *[(F.round(c, 9) + 0.0).alias(c) for c in var]
    )


def _dispersion(spark, sf):
    cov = V.coverage_by_unit(spark, sf)
    ends = C.level_extremes(cov, LEVELS)
    kept = C.valid_units(ends).filter("scenario = 'pop'")
    return R.dispersion_levels(kept, LEVELS, "prefecture", "province", "region")


@query("ref_table1", f"""
SELECT region, r_name AS region_name, period, count(*) AS n, {rd('min(coverage) * 100', 4)} AS min,
       {rd('quantile_cont(coverage, 0.25) * 100', 4)} AS q1, {rd('avg(coverage) * 100', 4)} AS mean,
       {rd('median(coverage) * 100', 4)} AS median, {rd('quantile_cont(coverage, 0.75) * 100', 4)} AS q3,
       {rd('max(coverage) * 100', 4)} AS max, {rd('stddev_samp(coverage) * 100', 4)} AS sd
FROM v_unitcov JOIN v_valid USING (unit, period) JOIN region ON CAST(r_regionkey AS VARCHAR) = region
WHERE scenario = 'pop' GROUP BY 1, 2, 3""")
def ref_table1(spark, sf):
    cov = V.coverage_by_unit(spark, sf)
    kept = unit_levels(C.valid_units(cov).filter("scenario = 'pop'"), "unit", {"region": 1})
    names = V.scan(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("region"), F.col("r_name").alias("region_name")
    )
    return rounded(R.region_table(kept, names, by=["region", "period"]), 4)


BURDEN_SQL = f"""
b0 AS (SELECT unit, sum(cases) AS cases FROM v_cases WHERE year {SPAN} GROUP BY 1 HAVING count(*) = {len(PERIODS)}),
b1 AS (SELECT unit, cases, pop, cases / {len(PERIODS)} / pop AS burden FROM b0
       JOIN (SELECT unit, sum(pop) AS pop FROM v_pop WHERE period = {PERIODS[0]} AND age <= 5 GROUP BY 1) USING (unit)),
burden AS (SELECT *, (burden - avg(burden) OVER ()) / stddev_samp(burden) OVER () AS burden_s FROM b1)
"""


def burden(spark, sf, cube=None):
    cube = V.line_cube(spark, sf) if cube is None else cube
    base = V.pop(spark, sf, cube).filter(f"period = {PERIODS[0]} AND age <= 5").groupBy("unit").agg(F.sum("pop").alias("pop"))
    return R.burden_rate(V.cases(spark, sf, cube), base, PERIODS)


@query("burden_rate", f"""
WITH {BURDEN_SQL}
SELECT unit, cases, pop, {rd('burden')} AS burden, {rd('burden_s')} AS burden_s FROM burden""")
def burden_rate(spark, sf):
    return rounded(burden(spark, sf))
