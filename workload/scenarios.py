"""Imputation, reconciliation, bounds, scenario grids, projection and regression input."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import shape as S
from panelweave.operators.impute import annualise, impute_monthly
from panelweave.plans import events as E, population as P, reports as R, scenarios as SC
from panelweave.session import stage
from workload import views as V
from workload.pipelines import BURDEN_SQL, burden
from workload.registry import FACTOR, PERIODS, SPAN, query, rd, rounded

IMPUTE_SQL = """
k AS (SELECT DISTINCT unit, period FROM v_event_month),
g AS (SELECT k.unit, k.period, CAST(m.mon AS INTEGER) AS mon, k.period * 12 + m.mon AS t, e.events AS x FROM k CROSS JOIN range(1, 13) m(mon)
      LEFT JOIN v_event_month e ON e.unit = k.unit AND e.period = k.period AND e.mon = m.mon),
f AS (SELECT *, count(x) OVER (PARTITION BY unit) AS n_obs,
        last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(x IGNORE NULLS) OVER b AS x0,
        first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(x IGNORE NULLS) OVER a AS x1
      FROM g WINDOW b AS (PARTITION BY unit ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT unit, period, mon, n_obs, x AS events,
             CASE WHEN x IS NOT NULL THEN x WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) * (t - t0) / (t1 - t0)
                  ELSE coalesce(x0, x1) END AS filled FROM f WHERE n_obs > 3)"""


@query("impute_monthly_linear", f"""
WITH {IMPUTE_SQL} SELECT unit, period, mon, n_obs, events, {rd('filled')} AS filled FROM filled""")
def impute_monthly_linear(spark, sf):
    monthly = impute_monthly(V.event_month(spark, sf), ["unit"], "period", "mon", "events")[1]
    return rounded(monthly.select("unit", "period", "mon", "n_obs", "events", "filled"))


@query("impute_annual_linear", f"""
WITH {IMPUTE_SQL} SELECT unit, period, {rd('sum(filled)')} AS events FROM filled GROUP BY 1, 2""")
def impute_annual_linear(spark, sf):
    return rounded(impute_monthly(V.event_month(spark, sf), ["unit"], "period", "mon", "events")[0])


# The tridiagonal system of each unit is swept forward and back by recursion over its knots.
SPLINE_SQL = """
k AS (SELECT DISTINCT unit, period FROM v_event_month),
g AS (SELECT k.unit, k.period, CAST(m.mon AS INTEGER) AS mon, k.period * 12 + m.mon AS t, e.events AS x FROM k CROSS JOIN range(1, 13) m(mon)
      LEFT JOIN v_event_month e ON e.unit = k.unit AND e.period = k.period AND e.mon = m.mon),
n AS (SELECT unit, t, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY unit) AS n, lag(t) OVER w AS ta, lag(x) OVER w AS xa,
             lead(t) OVER w AS tb, lead(x) OVER w AS xb, lead(t, 2) OVER w AS tc, lead(x, 2) OVER w AS xc, lead(t, 3) OVER w AS td,
             lead(x, 3) OVER w AS xd, lag(t, 2) OVER w AS tp, lag(x, 2) OVER w AS xp, lag(t, 3) OVER w AS tq, lag(x, 3) OVER w AS xq
      FROM g WHERE x IS NOT NULL WINDOW w AS (PARTITION BY unit ORDER BY t)),
e AS (SELECT unit, i, n, t, x,
        CAST(CASE WHEN i = 1 THEN 0 WHEN i = n THEN -1 ELSE t - ta END AS DOUBLE) AS a,
        CAST(CASE WHEN i = 1 THEN -1 WHEN i = n THEN 1 ELSE 2 * (tb - ta) END AS DOUBLE) AS b,
        CAST(CASE WHEN i = 1 THEN 1 WHEN i = n THEN 0 ELSE tb - t END AS DOUBLE) AS c,
        CASE WHEN i = 1 THEN 6 * (tb - t) * (((xd - xc) / (td - tc) - (xc - xb) / (tc - tb)) / (td - tb)
                                          - ((xc - xb) / (tc - tb) - (xb - x) / (tb - t)) / (tc - t)) / (td - t)
             WHEN i = n THEN 6 * (t - ta) * (((x - xa) / (t - ta) - (xa - xp) / (ta - tp)) / (t - tp)
                                          - ((xa - xp) / (ta - tp) - (xp - xq) / (tp - tq)) / (ta - tq)) / (t - tq)
             ELSE 6 * ((xb - x) / (tb - t) - (x - xa) / (t - ta)) END AS d
      FROM n WHERE n > 3),
down AS (
  SELECT unit, i, c / b AS cc, d / b AS dd FROM e WHERE i = 1
  UNION ALL
  SELECT e.unit, e.i, e.c / (e.b - e.a * p.cc), (e.d - e.a * p.dd) / (e.b - e.a * p.cc) FROM down p JOIN e ON e.unit = p.unit AND e.i = p.i + 1),
up AS (
  SELECT d.unit, d.i, d.dd AS m FROM down d JOIN e ON e.unit = d.unit AND e.i = d.i WHERE e.i = e.n
  UNION ALL
  SELECT d.unit, d.i, d.dd - d.cc * u.m FROM up u JOIN down d ON d.unit = u.unit AND d.i = u.i - 1),
piece AS (SELECT e.unit, e.n, e.i, e.t AS t0, lead(e.t) OVER w AS t1, e.x AS x0, lead(e.x) OVER w AS x1, m AS m0, lead(m) OVER w AS m1,
                 lead(e.t) OVER w - e.t AS h FROM e JOIN up USING (unit, i) WINDOW w AS (PARTITION BY unit ORDER BY e.i)),
filled AS (SELECT g.unit, g.period, g.mon, p.n AS n_obs, g.x AS events, CASE WHEN g.x IS NOT NULL THEN g.x ELSE
        (m0 * pow(t1 - t, 3) + m1 * pow(t - t0, 3)) / (6 * h) + (x0 / h - m0 * h / 6) * (t1 - t) + (x1 / h - m1 * h / 6) * (t - t0) END AS filled
      FROM g JOIN piece p ON p.unit = g.unit AND p.i < p.n AND (t >= t0 OR p.i = 1) AND (t < t1 OR p.i = p.n - 1))"""


@query("impute_monthly_spline", f"""
WITH RECURSIVE {SPLINE_SQL} SELECT unit, period, mon, n_obs, events, {rd('filled', 5)} AS filled FROM filled""")
def impute_monthly_spline(spark, sf):
    monthly = impute_monthly(V.event_month(spark, sf), ["unit"], "period", "mon", "events", method="spline")[1]
    return rounded(monthly.select("unit", "period", "mon", F.col("n_obs").cast("long").alias("n_obs"), "events", "filled"), 5)


@query("event_reconcile", f"""
WITH {IMPUTE_SQL},
a AS (SELECT unit, period, sum(events) * 12 / count(*) AS events FROM v_event_month WHERE mon <= 9 GROUP BY 1, 2),
i AS (SELECT unit, period, sum(filled) AS events FROM filled GROUP BY 1, 2),
w AS (SELECT unit, period, events FROM v_event WHERE period {SPAN}),
u AS (SELECT * FROM v_event UNION ALL SELECT * FROM a UNION ALL SELECT * FROM i UNION ALL SELECT * FROM w),
d AS (SELECT DISTINCT unit, period, round(events, 6) AS events FROM u WHERE events IS NOT NULL)
SELECT unit, period, {rd('avg(events)', 5)} AS events, count(*) AS n_values FROM d GROUP BY 1, 2""")
def event_reconcile(spark, sf):
    """Annual table, wide annual table, annualised part year and imputed year, reconciled."""
    months = stage(V.event_month(spark, sf), "months")
    annual = months.groupBy("unit", "period").agg(F.sum("events").alias("events"))
    wide = S.to_wide(annual, ["unit"], "period", "events", PERIODS, "events_")
    long = S.to_long(wide, ["unit"], [f"events_{p}" for p in PERIODS], "period", "events", prefix="events_").withColumn(
        "period", F.col("period").cast("int")
    )
    part = annualise(months.filter("mon <= 9"), ["unit", "period"], "mon", "events").drop("n_month")
    imputed = impute_monthly(months, ["unit"], "period", "mon", "events")[0]
    sources = [s.withColumn("events", F.round("events", 6)) for s in (annual, long, part, imputed)]
    return rounded(E.event_reconcile(*sources), 5)


SHARE_SQL = """
st AS (SELECT unit, period, sum(CASE WHEN age = 5 THEN pop * num / den END) / sum(pop * num / den) AS share
       FROM v_pop JOIN v_survey USING (age) WHERE scenario = 'a' GROUP BY 1, 2),
yb AS (SELECT unit, period, sum(CASE WHEN age = 5 THEN pop END) / sum(pop) AS share FROM v_pop WHERE age <= 5 GROUP BY 1, 2),
shares AS (SELECT 'ST' AS source, * FROM st WHERE share IS NOT NULL UNION ALL SELECT 'YB', * FROM yb WHERE share IS NOT NULL)"""


def _shares(spark, sf, pop=None):
    pop = V.pop_table(spark, sf) if pop is None else pop
    survey = V.survey(spark).filter("scenario = 'a'")
    return S.union_named(
        SC.ageing_out_share(pop, survey, 5), SC.last_age_share(pop, 5), source="source", labels=["ST", "YB"]
    )


@query("ageing_out_share", f"WITH {SHARE_SQL} SELECT source, unit, period, {rd('share')} AS share FROM shares")
def ageing_out_share(spark, sf):
    return rounded(_shares(spark, sf).select("source", "unit", "period", "share"))


BOUND_SQL = SHARE_SQL + """,
e AS (SELECT s.source, v.unit, v.period, s.share, sum(events) OVER w AS c, row_number() OVER w AS i
      FROM v_event v JOIN shares s USING (unit, period) WHERE v.period BETWEEN 1996 AND 1998
      WINDOW w AS (PARTITION BY source, unit ORDER BY period)),
l AS (SELECT *, lag(c) OVER w AS c0, lag(share) OVER w AS a0 FROM e WINDOW w AS (PARTITION BY source, unit ORDER BY period)),
bounds AS (
  SELECT source, unit, period, 'LL' AS bound, CASE WHEN i = 1 THEN c * (1 - share) ELSE c * (1 - a0) END AS value FROM l
  UNION ALL SELECT source, unit, period, 'UL', CASE WHEN i = 1 THEN c ELSE c0 * (1 - a0) + (c - c0) END FROM l)"""


def _bounds(spark, sf, pop=None):
    return SC.ageing_out_bounds(V.event(spark, sf).filter("period BETWEEN 1996 AND 1998"), _shares(spark, sf, pop))


@query("ageing_out_bounds", f"WITH {BOUND_SQL} SELECT source, unit, period, bound, {rd('value')} AS value FROM bounds")
def ageing_out_bounds(spark, sf):
    return rounded(_bounds(spark, sf))


POPS_SQL = """
base AS (SELECT 'YB' AS pop_source, unit, period, eligible AS pop FROM v_elig WHERE eligible IS NOT NULL AND period BETWEEN 1996 AND 1998
         UNION ALL SELECT 'sur', unit, period, sum(pop) FROM v_pop WHERE age <= 5 AND period BETWEEN 1996 AND 1998 GROUP BY 1, 2, 3),
line AS (SELECT pop_source, unit, coalesce(regr_slope(pop, period), 0) * (1998 - avg(period)) + avg(pop) AS fitted, max_by(pop, period) AS carried
         FROM base WHERE period < 1998 GROUP BY 1, 2),
pops AS (SELECT pop_source, 'ob' AS process, unit, period, pop FROM base WHERE period < 1998
         UNION ALL SELECT pop_source, 'lm', unit, 1998, fitted FROM line UNION ALL SELECT pop_source, 'con', unit, 1998, carried FROM line)"""


def _pops(pop):
    """Observed population of two sources for 1996-97, and two projections for 1998."""
    pop = pop.filter("period < 1998 AND period >= 1996")
    elig = P.eligible_population(pop, FACTOR).select("unit", "period", F.col("eligible").alias("pop"))
    sur = P.risk_population(pop, 5).select("unit", "period", F.col("at_risk").alias("pop"))
    base = stage(S.union_named(elig, sur, source="pop_source", labels=["YB", "sur"]), "base")
    keyed = base.withColumn("_k", F.struct("pop_source", "unit"))
    line = SC.extrapolate_linear(keyed, 1998, "_k", "period", "pop").select("_k.*", "period", "fitted", "carried")
    return S.union_named(
        base.withColumn("process", F.lit("ob")),
        line.select("pop_source", "unit", "period", F.lit("lm").alias("process"), F.col("fitted").alias("pop")),
        line.select("pop_source", "unit", "period", F.lit("con").alias("process"), F.col("carried").alias("pop")),
    )


GRID_SQL = BOUND_SQL + "," + POPS_SQL + """,
raw AS (SELECT pop_source, process, source, bound, unit, period, value / nullif(pop, 0) AS cov FROM pops JOIN bounds USING (unit, period)),
grid AS (SELECT * FROM raw WHERE unit NOT IN (SELECT unit FROM raw WHERE cov < 0 OR cov > 1))"""


def _grid(spark, sf):
    pop = V.pop_table(spark, sf)
    return SC.scenario_grid(stage(_bounds(spark, sf, pop), "bounds"), _pops(pop))


@query("scenario_grid", f"WITH {GRID_SQL} SELECT pop_source, process, source, bound, unit, period, {rd('cov')} AS cov FROM grid")
def scenario_grid(spark, sf):
    return rounded(_grid(spark, sf))


CHOSEN = [("YB", "lm", "YB", "LL"), ("YB", "con", "ST", "UL")]


@query("scenario_table1", f"""
WITH {GRID_SQL},
size AS (SELECT substr(unit, 1, 1) AS region, count(*) AS sample_size FROM v_event WHERE period = 1998 AND NOT (substr(unit, 4, 1) = '1' AND period = 1997) GROUP BY 1)
SELECT r_name AS region_name, pop_source, process, source, bound, coalesce(max(sample_size), 0) AS sample_size, count(*) AS n, {rd('min(cov) * 100', 4)} AS min,
       {rd('quantile_cont(cov, 0.25) * 100', 4)} AS q1, {rd('avg(cov) * 100', 4)} AS mean, {rd('median(cov) * 100', 4)} AS median,
       {rd('quantile_cont(cov, 0.75) * 100', 4)} AS q3, {rd('max(cov) * 100', 4)} AS max, {rd('stddev_samp(cov) * 100', 4)} AS sd
FROM grid JOIN region ON CAST(r_regionkey AS VARCHAR) = substr(unit, 1, 1) LEFT JOIN size s ON s.region = substr(unit, 1, 1)
WHERE period = 1998 AND cov IS NOT NULL AND (pop_source, process, source, bound) IN ({", ".join(map(str, CHOSEN))}) GROUP BY ALL""")
def scenario_table1(spark, sf):
    """Table 1 of two scenarios: population source, process, age structure and bound are arguments."""
    from workload.pipelines import _availability

    cells = stage(_grid(spark, sf).filter("cov IS NOT NULL"), "grid")
    names = V.scan(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("region"), F.col("r_name").alias("region_name"))
    present = stage(_availability(spark, sf), "availability")
    out = None
    for chosen in CHOSEN:
        axes = dict(zip(("pop_source", "process", "source", "bound"), chosen))
        one = R.scenario_table(cells, present, names, axes, 1998).drop("region").withColumns({c: F.lit(v) for c, v in axes.items()})
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query("scenario_compare", f"""
WITH {GRID_SQL}
SELECT pop_source, source, bound, unit, period, {rd("max(cov) FILTER (process = 'lm')")} AS lm, {rd("max(cov) FILTER (process = 'con')")} AS con
FROM grid GROUP BY 1, 2, 3, 4, 5 HAVING count(*) FILTER (process = 'lm') > 0""")
def scenario_compare(spark, sf):
    keys = ["pop_source", "source", "bound", "unit", "period"]
    return rounded(SC.scenario_compare(_grid(spark, sf), "process", "lm", "con", keys))


@query("scenario_compare_age_structure", f"""
WITH {GRID_SQL}
SELECT pop_source, process, bound, unit, period, {rd('max(cov) FILTER (source = $q$YB$q$)')} AS "YB", {rd('max(cov) FILTER (source = $q$ST$q$)')} AS "ST"
FROM grid GROUP BY 1, 2, 3, 4, 5""".replace("$q$", "'"))
def scenario_compare_age_structure(spark, sf):
    keys = ["pop_source", "process", "bound", "unit", "period"]
    return rounded(SC.scenario_compare(_grid(spark, sf), "source", "YB", "ST", keys))


@query("trend_shape", f"""
WITH w AS (SELECT unit, max(events) FILTER (period = 1996) AS a, max(events) FILTER (period = 1997) AS b, max(events) FILTER (period = 1998) AS c
           FROM v_event GROUP BY 1),
s AS (SELECT unit, a + b + c AS tot, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM w WHERE a + b + c > 0)
SELECT unit, tot, {rd('a')} AS share_1996, {rd('b')} AS share_1997, {rd('c')} AS share_1998,
       {rd('abs(a - 0.33) + abs(b - 0.33) + abs(c - 0.33)')} AS k,
       CASE WHEN (b >= a OR abs(b - a) < 0.1) AND (c >= b OR abs(c - b) < 0.1) THEN 'increasing or stabilising' ELSE 'other' END AS type FROM s""")
def trend_shape(spark, sf):
    return rounded(SC.trend_shape(V.event(spark, sf), [1996, 1997, 1998]))


@query("trend_tally", f"""
WITH w AS (SELECT unit, max(events) FILTER (period = 1996) AS a, max(events) FILTER (period = 1997) AS b, max(events) FILTER (period = 1998) AS c
           FROM v_event GROUP BY 1),
s AS (SELECT unit, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM w WHERE a + b + c > 0),
t AS (SELECT CASE WHEN (b >= a OR abs(b - a) < 0.1) AND (c >= b OR abs(c - b) < 0.1) THEN 'increasing or stabilising' ELSE 'other' END AS type FROM s)
SELECT type, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS tot, {rd('count(*) / sum(count(*)) OVER ()')} AS p FROM t GROUP BY 1""")
def trend_tally(spark, sf):
    return rounded(SC.share_of_total(SC.trend_shape(V.event(spark, sf), [1996, 1997, 1998]), "type"))


@query("extrapolate_linear", f"""
SELECT unit, 2002 AS period, {rd('coalesce(regr_slope(events, period), 0) * (2002 - avg(period)) + avg(events)', 5)} AS fitted, max_by(events, period) AS carried
FROM v_event GROUP BY 1""")
def extrapolate_linear(spark, sf):
    return rounded(SC.extrapolate_linear(V.event(spark, sf), 2002, value="events"), 5)


FRAME_SQL = BURDEN_SQL + """,
r0 AS (SELECT unit, period, sum(pop) AS tot, sum(CASE WHEN age <= 5 THEN pop END) / sum(pop) AS p_risk FROM v_pop GROUP BY 1, 2),
r AS (SELECT *, (p_risk - avg(p_risk) OVER ()) / stddev_samp(p_risk) OVER () AS p_risk_s,
             (tot - avg(tot) OVER ()) / stddev_samp(tot) OVER () AS tot_s FROM r0),
x AS (SELECT *, (wealth - avg(wealth) OVER ()) / stddev_samp(wealth) OVER () AS wealth_s,
             (tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () AS tax_s FROM v_cov_x),
cw AS (SELECT unit, period, max(coverage) FILTER (scenario = 'pop') AS coverage_pop, max(coverage) FILTER (scenario = 'a') AS coverage_a,
              max(coverage) FILTER (scenario = 'b') AS coverage_b FROM v_unitcov GROUP BY 1, 2),
frame AS (SELECT cw.unit, period, substr(cw.unit, 1, 3) AS province, coverage_pop, coverage_a, coverage_b, wealth, tax, wealth_s, tax_s,
                 burden, burden_s, tot, p_risk, p_risk_s, tot_s
          FROM cw JOIN x USING (unit) JOIN burden USING (unit) JOIN r USING (unit, period)
          WHERE period = 1998 AND coverage_pop <= 1 AND coverage_a <= 1 AND coverage_b <= 1 AND substr(cw.unit, 1, 3) <> '003')"""
FRAME_COLUMNS = ["coverage_pop", "coverage_a", "coverage_b", "wealth", "tax", "wealth_s", "tax_s", "burden", "burden_s",
                 "p_risk", "p_risk_s", "tot_s"]


def regression_inputs(spark, sf, covariates: list[str]):
    """(coverage by scenario, covariates, burden, risk), all from one reading of the lines."""
    cube = V.line_cube(spark, sf)
    risk = P.risk_population(V.pop(spark, sf, cube), 5).select("unit", "period", "tot", "p_risk")
    return V.coverage_wide(spark, sf, cube), V.covariates(spark, sf, cube).select("unit", *covariates), burden(spark, sf, cube), risk


def frame(spark, sf):
    """Regression frame of 1998 without one province; a stage table, since several models read it."""
    out = R.regression_frame(*regression_inputs(spark, sf, ["wealth", "tax"]), 1998, ("province", 3), ["003"])
    return stage(out.select("unit", "period", "province", "tot", *FRAME_COLUMNS), "frame")


@query("regression_frame", f"""
WITH {FRAME_SQL}
SELECT unit, period, province, tot, {', '.join(f"{rd(c)} AS {c}" for c in FRAME_COLUMNS)} FROM frame""")
def regression_frame(spark, sf):
    return rounded(frame(spark, sf))


@query("extreme_units", f"""
WITH {FRAME_SQL},
k AS (SELECT *, cume_dist() OVER (ORDER BY p_risk) AS rank_high, cume_dist() OVER (ORDER BY coverage_pop) AS rank_low FROM frame)
SELECT s_name AS name, split_part(n_name, '_', 1) AS province_word, {rd('rank_high')} AS rank_high, {rd('rank_low')} AS rank_low,
       CASE WHEN rank_high >= 0.9 AND rank_low <= 0.1 THEN 'inner' ELSE 'outer' END AS severity
FROM k JOIN v_unit USING (unit) WHERE rank_high >= 0.8 AND rank_low <= 0.2""")
def extreme_units(spark, sf):
    from panelweave.functions.text import first_word

    ranked = R.extreme_units(frame(spark, sf).select("unit", "p_risk", "coverage_pop"), "p_risk", "coverage_pop")
    named = ranked.join(V.units(spark, sf).select("unit", "s_name", "n_name"), "unit")
    word = first_word(F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")))
    return rounded(named.select(F.col("s_name").alias("name"), word.alias("province_word"), "rank_high", "rank_low", "severity")).orderBy("severity", "name")
