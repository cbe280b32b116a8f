"""Regression, association, group contrasts and the zero-inflated beta model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.text import unit_levels
from panelweave.operators import models as M, zib as Z
from panelweave.operators.cohorts import running_sum
from panelweave.operators.ranks import distribution, ntile_rank
from panelweave.operators.shape import sum_columns, to_long
from panelweave.plans import population as P
from workload import views as V
from workload.registry import FACTOR, query, rd, rounded
from workload.scenarios import FRAME_SQL, frame

RATE_SQL = """
d AS (SELECT unit, period, substr(unit, 1, 1) AS region, events / eligible AS y, eligible / tot AS x1, tot / 1000 AS x2
      FROM v_event JOIN v_elig USING (unit, period) WHERE eligible IS NOT NULL)"""


def _rates(spark, sf):
    elig = P.unit_eligibility(V.pop(spark, sf), FACTOR, "unit", "age", "period", "pop").filter("eligible IS NOT NULL")
    return unit_levels(V.event(spark, sf).join(elig, ["unit", "period"]), "unit", {"region": 1}).select(
        "unit", "period", "region", (F.col("events") / F.col("eligible")).alias("y"),
        (F.col("eligible") / F.col("tot")).alias("x1"), (F.col("tot") / 1000).alias("x2"), "tot", "eligible",
    )


# Two covariates and one factor in closed form: slopes from moments inside the groups,
# group effects from the group means.
OLS_SQL = RATE_SQL + """,
g AS (SELECT region, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, sum((x1 - a1) * (x1 - a1)) AS s11,
             sum((x1 - a1) * (x2 - a2)) AS s12, sum((x2 - a2) * (x2 - a2)) AS s22, sum((x1 - a1) * (y - ay)) AS s1y,
             sum((x2 - a2) * (y - ay)) AS s2y, sum((y - ay) * (y - ay)) AS syy
      FROM (SELECT *, avg(y) OVER w AS ay, avg(x1) OVER w AS a1, avg(x2) OVER w AS a2 FROM d WINDOW w AS (PARTITION BY region)) GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22, sum(s1y) AS s1y, sum(s2y) AS s2y, sum(syy) AS syy FROM g),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM t),
s AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - k - 2) AS s2 FROM b),
r AS (SELECT n AS n0, my AS y0, m1 AS z1, m2 AS z2 FROM g ORDER BY region LIMIT 1),
coef AS (
  SELECT 'x1' AS term, b1 AS estimate, sqrt(s2 * s22 / det) AS se FROM s
  UNION ALL SELECT 'x2', b2, sqrt(s2 * s11 / det) FROM s
  UNION ALL SELECT '(intercept)', y0 - b1 * z1 - b2 * z2, sqrt(s2 * (1 / n0 + (z1 * z1 * s22 - 2 * z1 * z2 * s12 + z2 * z2 * s11) / det)) FROM s, r
  UNION ALL SELECT 'region=' || region, my - y0 - b1 * (m1 - z1) - b2 * (m2 - z2),
    sqrt(s2 * (1 / g.n + 1 / n0 + ((m1 - z1) * (m1 - z1) * s.s22 - 2 * (m1 - z1) * (m2 - z2) * s.s12 + (m2 - z2) * (m2 - z2) * s.s11) / det))
  FROM g, s, r WHERE region > (SELECT min(region) FROM g))"""


def _fit(spark, sf):
    return M.ols(_rates(spark, sf), "y", ["x1", "x2"], ["region"])


@query("ols_multi", f"""
WITH {OLS_SQL}
SELECT term, {rd('estimate')} AS estimate, {rd('se')} AS se, {rd('estimate / se')} AS statistic, {rd('estimate - 1.96 * se')} AS lo,
       {rd('estimate + 1.96 * se')} AS hi FROM coef""")
def ols_multi(spark, sf):
    return rounded(_fit(spark, sf).table(spark).select("term", "estimate", "se", "statistic", "lo", "hi"))


@query("ols_multi_reference_level", f"""
WITH {OLS_SQL}
SELECT split_part(term, '=', 2) AS level, {rd('estimate')} AS estimate, {rd('se')} AS se FROM coef WHERE term LIKE 'region=%'
UNION ALL SELECT (SELECT min(region) FROM g), 0, 0""")
def ols_multi_reference_level(spark, sf):
    table = _fit(spark, sf).table(spark, reference_level=True).filter("term LIKE 'region=%'")
    return rounded(table.select(F.substring_index("term", "=", -1).alias("level"), "estimate", "se"))


@query("drop_leading_terms", f"""
WITH {OLS_SQL}
SELECT term, {rd('estimate')} AS estimate, CAST(ntile(4) OVER (ORDER BY estimate, term) AS INTEGER) AS nt FROM coef WHERE term NOT IN ('(intercept)', 'x1', 'x2')""")
def drop_leading_terms(spark, sf):
    table = _fit(spark, sf).table(spark).filter(~F.col("term").isin("(intercept)", "x1", "x2")).select("term", "estimate")
    return rounded(ntile_rank(table, ["estimate", "term"], 4, "nt").select("term", "estimate", "nt"))


@query("glm_gaussian", f"WITH {OLS_SQL} SELECT term, {rd('estimate')} AS estimate, {rd('se')} AS se FROM coef")
def glm_gaussian(spark, sf):
    return rounded(M.glm_gaussian(_rates(spark, sf), "y", ["x1", "x2"], ["region"]).select("term", "estimate", "se"))


@query("vif", f"""
WITH {OLS_SQL},
a AS (SELECT regr_sxx(x1, x1) AS t11, regr_sxy(x1, x2) AS t12, regr_sxx(x2, x2) AS t22 FROM d)
SELECT 'x1' AS term, 1 AS df, {rd('t11 / (s11 - s12 * s12 / s22)')} AS gvif FROM a, t
UNION ALL SELECT 'x2', 1, {rd('t22 / (s22 - s12 * s12 / s11)')} FROM a, t
UNION ALL SELECT 'region', CAST(k - 1 AS INTEGER), {rd('(t11 * t22 - t12 * t12) / (s11 * s22 - s12 * s12)')} FROM a, t""")
def vif(spark, sf):
    return rounded(M.vif(_fit(spark, sf), spark).select("term", "df", "gvif"))


@query("ols_simple", f"""
WITH w AS (SELECT unit, period, max(coverage) FILTER (scenario = 'pop') AS p, max(coverage) FILTER (scenario = 'a') AS a,
                  max(coverage) FILTER (scenario = 'b') AS b FROM v_unitcov GROUP BY 1, 2),
l AS (SELECT 'a' AS name, p, a AS value FROM w UNION ALL SELECT 'b', p, b FROM w)
SELECT name, count(*) AS n, {rd('regr_slope(value, p)')} AS slope, {rd('regr_intercept(value, p)')} AS intercept, {rd('regr_r2(value, p)')} AS r2,
       {rd('sqrt((regr_syy(value, p) - pow(regr_sxy(value, p), 2) / regr_sxx(value, p)) / (count(*) - 2) / regr_sxx(value, p))')} AS slope_se
FROM l GROUP BY 1""")
def ols_simple(spark, sf):
    wide = V.coverage_wide(spark, sf).withColumnsRenamed({"coverage_a": "a", "coverage_b": "b"})
    long = to_long(wide, ["unit", "period", "coverage_pop"], ["a", "b"])
    return rounded(M.ols_simple(long, "value", "coverage_pop", ["name"]))


@query("ols_factor", f"""
WITH {RATE_SQL}, g AS (SELECT region, count(*) AS n, avg(x1) AS mean, var_pop(x1) AS v FROM d GROUP BY 1),
r AS (SELECT n AS n0, mean AS m0, region AS f0 FROM g ORDER BY region LIMIT 1),
s AS (SELECT sum(n * v) / (sum(n) - count(*)) AS s2 FROM g)
SELECT region, n, {rd('mean')} AS mean, {rd('mean - m0')} AS estimate,
       {rd('CASE WHEN region = f0 THEN 0 ELSE sqrt(s2 * (1 / n + 1 / n0)) END')} AS se FROM g, r, s""")
def ols_factor(spark, sf):
    return rounded(M.ols_factor(_rates(spark, sf), "x1", "region"))


@query("fitted_vs_observed", f"""
WITH d AS (SELECT unit, period, substr(unit, 1, 1) AS region, eligible AS observed, ln(eligible) AS y, ln(tot) AS x FROM v_elig WHERE eligible IS NOT NULL),
m AS (SELECT *, avg(y) OVER w AS ay, avg(x) OVER w AS ax FROM d WINDOW w AS (PARTITION BY region)),
b AS (SELECT sum((x - ax) * (y - ay)) / sum((x - ax) * (x - ax)) AS b FROM m)
SELECT unit, period, observed, {rd('exp(ay + b * (x - ax))', 5)} AS fitted FROM m, b""")
def fitted_vs_observed(spark, sf):
    elig = P.unit_eligibility(V.pop(spark, sf), FACTOR, "unit", "age", "period", "pop").filter("eligible IS NOT NULL")
    logs = unit_levels(elig, "unit", {"region": 1}).withColumns({"log_e": F.ln("eligible"), "log_t": F.ln("tot")})
    fit = M.ols(logs, "log_e", ["log_t"], ["region"])
    return rounded(logs.select("unit", "period", F.col("eligible").alias("observed"), F.exp(fit.score()).alias("fitted")), 5)


CORR_COLUMNS = ["wealth_s", "tax_s", "burden_s", "p_risk_s", "tot_s", "coverage_pop"]


@query("corr_matrix", f"WITH {FRAME_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {rd(f'corr({a}, {b})')} AS r FROM frame" for a in CORR_COLUMNS for b in CORR_COLUMNS
))
def corr_matrix(spark, sf):
    return rounded(M.corr_matrix(frame(spark, sf), CORR_COLUMNS))


@query("chisq_independence", f"""
WITH o AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY 1, 2),
s AS (SELECT sum(o) AS n, sum(o * o / (r * c)) AS q, count(DISTINCT a) AS ra, count(DISTINCT b) AS cb FROM (
  SELECT *, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) AS r, CAST(sum(o) OVER (PARTITION BY b) AS DOUBLE) AS c FROM o)),
x AS (SELECT n * (q - 1) AS x, (ra - 1) * (cb - 1) AS df, CAST(n AS BIGINT) AS n FROM s)
SELECT {rd('x')} AS statistic, df, n, {rd('exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6)')} AS p_value FROM x""")
def chisq_independence(spark, sf):
    """Eight degrees of freedom, where the tail has a closed form for the oracle."""
    return rounded(M.chisq_test(V.scan(spark, sf, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus"))


FLAG_SQL = """
x AS (SELECT v_cov_x.*, coalesce(e.events, 0) > 60 AS in_reg FROM v_cov_x LEFT JOIN (SELECT * FROM v_event WHERE period = 1998) e USING (unit))"""
FLAG_COLUMNS = ["wealth", "discount", "tax", "lines"]


def _flagged(spark, sf):
    ev = V.event(spark, sf).filter("period = 1998").select("unit", "events")
    return V.covariates(spark, sf).join(ev, "unit", "left").withColumn("in_reg", F.coalesce("events", F.lit(0.0)) > 60).drop("events")


@query("cohens_d", f"WITH {FLAG_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS name, count({c}) FILTER (in_reg) AS n_in, count({c}) FILTER (NOT in_reg) AS n_out,
  {rd(f'''(avg({c}) FILTER (in_reg) - avg({c}) FILTER (NOT in_reg)) / sqrt(((count(*) FILTER (in_reg) - 1) * var_samp({c}) FILTER (in_reg)
  + (count(*) FILTER (NOT in_reg) - 1) * var_samp({c}) FILTER (NOT in_reg)) / (count(*) - 2))''')} AS d FROM x""" for c in FLAG_COLUMNS))
def cohens_d(spark, sf):
    return rounded(M.cohens_d(_flagged(spark, sf), FLAG_COLUMNS, "in_reg"))


@query("group_compare", f"WITH {FLAG_SQL} " + " UNION ALL ".join(f"""
SELECT '{c}' AS name, in_reg, count({c}) AS n, {rd(f'min({c})')} AS min, {rd(f'quantile_cont({c}, 0.25)')} AS q1, {rd(f'avg({c})')} AS mean,
  {rd(f'median({c})')} AS median, {rd(f'quantile_cont({c}, 0.75)')} AS q3, {rd(f'max({c})')} AS max, {rd(f'stddev_samp({c})')} AS sd
FROM x GROUP BY in_reg""" for c in FLAG_COLUMNS))
def group_compare(spark, sf):
    return rounded(M.group_compare(_flagged(spark, sf), FLAG_COLUMNS, "in_reg"))


# ---- zero-inflated beta model: share of urgent orders per customer


def _shares(spark, sf):
    urgent = F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))
    per = V.scan(spark, sf, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(urgent.alias("share"))
    c = V.scan(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).filter("share < 1").select(
        "c_custkey", "share", (F.col("c_acctbal") / 1000).alias("balance"), F.col("c_mktsegment").alias("segment")
    )


SHARE_SQL = """
v AS (SELECT c_custkey, c_mktsegment AS segment, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS share
      FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 HAVING avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) < 1)"""


@query("zib_zero_part", f"""
WITH {SHARE_SQL},
g AS (SELECT segment, CAST(count(*) FILTER (share = 0) AS DOUBLE) AS z, CAST(count(*) FILTER (share > 0) AS DOUBLE) AS p FROM v GROUP BY 1),
r AS (SELECT z AS z0, p AS p0, segment AS s0 FROM g ORDER BY segment LIMIT 1)
SELECT CASE WHEN segment = s0 THEN '(intercept)' ELSE 'segment=' || segment END AS term,
       {rd('CASE WHEN segment = s0 THEN ln(z / p) ELSE ln(z / p) - ln(z0 / p0) END', 5)} AS estimate,
       {rd('sqrt(1 / z + 1 / p + CASE WHEN segment = s0 THEN 0 ELSE 1 / z0 + 1 / p0 END)', 5)} AS se FROM g, r""")
def zib_zero_part(spark, sf):
    """With one factor the zero part has a closed form."""
    fit = Z.zib_regression(_shares(spark, sf), "share", [], nu=["segment"], factors=["segment"])
    return rounded(fit.table(spark).filter("part = 'nu'").select("term", "estimate", "se"), 5)


def _full(spark, sf, model="full", mu=("balance", "segment"), **options):
    return Z.zib_regression(_shares(spark, sf), "share", list(mu), factors=["segment"], model=model, **options)


@query("zib_regression")
def zib_regression(spark, sf):
    fit = _full(spark, sf, sigma=["balance"], nu=["balance"])
    return rounded(fit.table(spark), 4)


@query("lr_test")
def lr_test(spark, sf):
    models = [Z.ZibModel("no segment", "share", ["balance"]), Z.ZibModel("full", "share", ["balance", "segment"])]
    return rounded(Z.lr_test(*Z.zib_models(_shares(spark, sf), models, ["segment"]), spark), 4)


@query("lr_test_zero_part", f"""
WITH {SHARE_SQL},
g AS (SELECT segment, CAST(count(*) FILTER (share = 0) AS DOUBLE) AS z, CAST(count(*) FILTER (share > 0) AS DOUBLE) AS p FROM v GROUP BY 1),
l AS (SELECT sum(z * ln(z / (z + p)) + p * ln(p / (z + p))) - sum(z) * ln(sum(z) / sum(z + p)) - sum(p) * ln(sum(p) / sum(z + p)) AS gain,
             CAST(count(*) - 1 AS INTEGER) AS df FROM g)
SELECT 'same zeros' AS reduced, 'zeros by segment' AS "full", {rd('2 * gain', 4)} AS statistic, df, {rd('exp(-gain) * (1 + gain)', 4)} AS p_value FROM l""")
def lr_test_zero_part(spark, sf):
    """Nested models that differ in the zero part only: closed form, four degrees of freedom."""
    models = [Z.ZibModel("same zeros", "share", ["balance"]), Z.ZibModel("zeros by segment", "share", ["balance"], nu=["segment"])]
    reduced, full = Z.zib_models(_shares(spark, sf), models, ["segment"])
    return rounded(Z.lr_test(reduced, full, spark), 4)


@query("effect_table_zero_part", f"""
WITH {SHARE_SQL},
g AS (SELECT segment, CAST(count(*) FILTER (share = 0) AS DOUBLE) AS z, CAST(count(*) FILTER (share > 0) AS DOUBLE) AS p FROM v GROUP BY 1),
r AS (SELECT z AS z0, p AS p0, segment AS s0 FROM g ORDER BY segment LIMIT 1),
e AS (SELECT segment, segment = s0 AS first, ln(z / p) - ln(z0 / p0) AS b, sqrt(1 / z + 1 / p + 1 / z0 + 1 / p0) AS se FROM g, r)
SELECT 'zeros' AS model, 'segment' AS term, segment AS level, {rd('CASE WHEN first THEN 1 ELSE exp(b) END', 5)} AS odds_ratio,
       {rd('CASE WHEN first THEN 1 ELSE exp(b - 1.96 * se) END', 5)} AS lo, {rd('CASE WHEN first THEN 1 ELSE exp(b + 1.96 * se) END', 5)} AS hi FROM e""")
def effect_table_zero_part(spark, sf):
    fit = _full(spark, sf, "zeros", [], nu=["segment"])
    return rounded(Z.effect_table(fit.table(spark).filter("part = 'nu'"), {"segment": fit.levels["segment"][0]}), 5)


@query("effect_table")
def effect_table(spark, sf):
    fit = _full(spark, sf)
    return rounded(Z.effect_table(fit.table(spark).filter("part = 'mu'"), {"segment": fit.levels["segment"][0]}), 4)


@query("model_summary")
def model_summary(spark, sf):
    univariate = Z.zib_models(_shares(spark, sf), [Z.ZibModel(name, "share", [name]) for name in ("balance", "segment")], ["segment"])
    return rounded(Z.model_summary(spark, *univariate), 4)


@query("quantile_residuals")
def quantile_residuals(spark, sf):
    shares = _shares(spark, sf)
    residuals = Z.quantile_residuals(shares, Z.zib_regression(shares, "share", ["balance"]), "c_custkey")
    return rounded(Z.normal_qq(residuals, "c_custkey"), 4)


# ---- functions over groups, columns and indexes


@query("per_group_function", f"""
SELECT unit, period, events, {rd('events / max(events) OVER (PARTITION BY unit)')} AS of_peak, sum(events) OVER (PARTITION BY unit ORDER BY period) AS so_far
FROM v_event""")
def per_group_function(spark, sf):
    """What a map over split groups does: windows that span one unit's periods."""
    from pyspark.sql import Window as W

    ev = V.event(spark, sf)
    peak = F.col("events") / F.max("events").over(W.partitionBy("unit"))
    return rounded(ev.withColumn("of_peak", peak).withColumn("so_far", running_sum("events", ["unit"], "period")))


@query("per_group_model_loop", f"""
SELECT unit, count(*) AS n, {rd('regr_slope(events, period)')} AS slope, {rd('regr_r2(events, period)')} AS r2 FROM v_event GROUP BY 1""")
def per_group_model_loop(spark, sf):
    return rounded(M.ols_simple(V.event(spark, sf), "events", "period", ["unit"]).select("unit", "n", "slope", "r2"))


@query("column_wise_function", f"""
SELECT l_suppkey, {rd('sum(l_quantity)')} AS l_quantity, {rd('sum(l_discount)', 3)} AS l_discount, {rd('sum(l_tax)', 3)} AS l_tax FROM lineitem GROUP BY 1""")
def column_wise_function(spark, sf):
    li = V.scan(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return rounded(sum_columns(li, ["l_suppkey"], ["l_quantity", "l_discount", "l_tax"], F.sum), 3)


@query("multi_index_loop", f"""
SELECT substr(unit, 1, 1) AS region, period, count(*) AS n, {rd('median(events)')} AS median, {rd('avg(events)')} AS mean FROM v_event GROUP BY 1, 2""")
def multi_index_loop(spark, sf):
    """One key column per loop index, one query for all of them."""
    ev = unit_levels(V.event(spark, sf), "unit", {"region": 1})
    return rounded(distribution(ev, "events", ["region", "period"]).select("region", "period", "n", "median", "mean"))
