"""Aggregations and window functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from panelweave.functions import nulls as N
from panelweave.functions.text import unit_levels
from panelweave.operators import cohorts as H, describe as D, keys as K, ranks as Q, shape as S
from panelweave.operators.impute import annualise, min_observations
from panelweave.plans import coverage as C, population as P, scenarios as SC
from panelweave.session import stage
from workload import views as V
from workload.pipelines import DISPERSION_SQL
from workload.registry import FACTOR, LEVELS, PERIODS, SPAN, query, rd, rounded

NULLED = """
n AS (SELECT unit, substr(unit, 1, 3) AS province, period, CASE WHEN events > 20 THEN events END AS events FROM v_event)"""


def _nulled(spark, sf):
    ev = unit_levels(V.event(spark, sf), "unit", {"province": 3})
    return ev.withColumn("events", F.when(F.col("events") > 20, F.col("events")))


@query("agg_sum_keys", f"""
WITH {NULLED}
SELECT province, period, CASE WHEN count(events) = count(*) THEN sum(events) END AS strict, sum(events) AS lenient,
       coalesce(sum(events), 0) AS zero FROM n GROUP BY 1, 2""")
def agg_sum_keys(spark, sf):
    return _nulled(spark, sf).groupBy("province", "period").agg(
        N.strict_sum("events").alias("strict"), F.sum("events").alias("lenient"), N.zero_sum("events").alias("zero")
    )


@query("agg_sum_multi", f"""
SELECT unit, {', '.join(f'sum(p{p}) AS p{p}' for p in PERIODS)} FROM (
  SELECT unit, age, {', '.join(f'sum(pop) FILTER (period = {p}) AS p{p}' for p in PERIODS)} FROM v_pop GROUP BY 1, 2) GROUP BY 1""")
def agg_sum_multi(spark, sf):
    wide = S.to_wide(V.pop(spark, sf), ["unit", "age"], "period", "pop", PERIODS, "p")
    return S.sum_columns(wide, ["unit"], [f"p{p}" for p in PERIODS], F.sum)


@query("agg_mean", f"""
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS period, length(o_orderpriority) AS v FROM orders)
SELECT o_custkey, period, {rd('avg(v)')} AS mean FROM d GROUP BY 1, 2""")
def agg_mean(spark, sf):
    o = V.scan(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderdate")
    d = o.select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("period"), F.length("o_orderpriority").alias("v")).distinct()
    return rounded(d.groupBy("o_custkey", "period").agg(F.avg("v").alias("mean")))


@query("agg_count", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_count(spark, sf):
    return V.scan(spark, sf, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("agg_share", f"""
SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS tot, {rd('count(*) / sum(count(*)) OVER ()')} AS p
FROM orders GROUP BY 1""")
def agg_share(spark, sf):
    return rounded(SC.share_of_total(V.scan(spark, sf, "orders", "o_orderpriority"), "o_orderpriority"))


@query("agg_distribution", f"""
SELECT o_orderpriority, count(*) AS n, {rd('min(o_totalprice)', 3)} AS min, {rd('quantile_cont(o_totalprice, 0.25)', 3)} AS q1,
       {rd('avg(o_totalprice)', 3)} AS mean, {rd('median(o_totalprice)', 3)} AS median,
       {rd('quantile_cont(o_totalprice, 0.75)', 3)} AS q3, {rd('max(o_totalprice)', 3)} AS max,
       {rd('stddev_samp(o_totalprice)', 3)} AS sd FROM orders GROUP BY 1""")
def agg_distribution(spark, sf):
    return rounded(Q.distribution(V.scan(spark, sf, "orders", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"]), 3)


@query("agg_quantiles", f"""
SELECT l_returnflag, {rd('quantile_cont(l_extendedprice, 0.25)', 4)} AS q1, {rd('quantile_cont(l_extendedprice, 0.5)', 4)} AS q2,
       {rd('quantile_cont(l_extendedprice, 0.75)', 4)} AS q3 FROM lineitem GROUP BY 1""")
def agg_quantiles(spark, sf):
    """Three hot groups over all lines."""
    li = V.scan(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    return rounded(Q.quantiles(li, "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["l_returnflag"]), 4)


@query("agg_median_sd", f"""
SELECT province, period, {rd('median(coverage)')} AS median, {rd('stddev_samp(coverage)')} AS sd
FROM v_unitcov JOIN v_valid USING (unit, period) WHERE scenario = 'pop' GROUP BY 1, 2 ORDER BY sd""")
def agg_median_sd(spark, sf):
    kept = unit_levels(V.coverage_valid(spark, sf).filter("scenario = 'pop'"), "unit", {"province": 3})
    out = Q.distribution(kept, "coverage", ["province", "period"])
    return rounded(out.select("province", "period", "median", "sd")).orderBy("sd")


@query("agg_partial_year_annualise", f"""
SELECT unit, period, {rd('sum(events) * 12 / count(*)')} AS events, count(*) AS n_month FROM v_event_month GROUP BY 1, 2""")
def agg_partial_year_annualise(spark, sf):
    return rounded(annualise(V.event_month(spark, sf), ["unit", "period"], "mon", "events"))


@query("agg_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def agg_distinct_rows(spark, sf):
    return V.scan(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("agg_duplicate_keys", f"""
WITH f AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || c_custkey AS unit,
                  CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS period, o_totalprice AS value
           FROM orders JOIN customer ON o_custkey = c_custkey),
bad AS (SELECT DISTINCT unit FROM (SELECT unit, period FROM f GROUP BY 1, 2 HAVING count(*) > 1) WHERE substr(unit, 1, 2) <> '05')
SELECT unit, period, {rd('sum(value)', 2)} AS value FROM f WHERE unit NOT IN (SELECT unit FROM bad) GROUP BY 1, 2""")
def agg_duplicate_keys(spark, sf):
    c = V.scan(spark, sf, "customer", "c_custkey", "c_nationkey")
    o = V.scan(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    unit = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), F.col("c_custkey").cast("string"))
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        unit.alias("unit"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.col("o_totalprice").alias("value")
    )
    return rounded(K.drop_duplicated_units(facts, "unit", ["unit", "period"], "value", F.substring("unit", 1, 2) == "05"), 2)


@query("agg_boxplot", f"""
WITH e AS (SELECT substr(unit, 1, 1) AS region, period, eligible / tot AS p FROM v_elig WHERE eligible IS NOT NULL),
h AS (SELECT region, period, count(*) AS n, quantile_cont(p, 0.25) AS q1, median(p) AS median, quantile_cont(p, 0.75) AS q3 FROM e GROUP BY 1, 2)
SELECT region, period, n, {rd('q1')} AS q1, {rd('median')} AS median, {rd('q3')} AS q3,
       {rd('min(p) FILTER (p >= q1 - 1.5 * (q3 - q1))')} AS whisker_low, {rd('max(p) FILTER (p <= q3 + 1.5 * (q3 - q1))')} AS whisker_high
FROM e JOIN h USING (region, period) GROUP BY region, period, n, q1, median, q3""")
def agg_boxplot(spark, sf):
    elig = unit_levels(P.eligible_population(V.pop(spark, sf), FACTOR), "unit", {"region": 1})
    return rounded(D.boxplot(elig, "p_risk", ["region", "period"]))


@query("agg_histogram", f"""
WITH t AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 29 AS w FROM t),
c AS (SELECT l_returnflag, CAST(floor((v - lo) / w + 0.5) AS INTEGER) AS bin, count(*) AS n FROM t, e GROUP BY 1, 2),
g AS (SELECT f.l_returnflag, CAST(b.bin AS INTEGER) AS bin FROM (SELECT DISTINCT l_returnflag FROM t) f, range(0, 30) b(bin))
SELECT l_returnflag, bin, {rd('lo + (bin - 0.5) * w', 4)} AS low, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (l_returnflag, bin), e""")
def agg_histogram(spark, sf):
    li = V.scan(spark, sf, "lineitem", "l_returnflag", "l_extendedprice")
    return rounded(D.histogram(li, "l_extendedprice", ["l_returnflag"]), 4)


KDE_POINTS = 512


@query("agg_kde_1d", f"""
WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders),
s AS (SELECT g, count(*) AS n, min(v) AS lo0, max(v) AS hi0,
             2 * 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM v GROUP BY 1),
t AS (SELECT g, n, h, lo0 - 3 * h AS lo, (hi0 - lo0 + 6 * h) / {KDE_POINTS - 1} AS step FROM s),
p AS (SELECT g, n, h, lo, step, (v - lo) / step AS q FROM v JOIN t USING (g)),
b AS (SELECT g, i, sum(c) AS c FROM (
  SELECT g, CAST(floor(q) AS INTEGER) AS i, 1 - (q - floor(q)) AS c FROM p
  UNION ALL SELECT g, CAST(floor(q) + 1 AS INTEGER), q - floor(q) FROM p) GROUP BY 1, 2)
SELECT t.g AS o_orderpriority, CAST(k.point AS INTEGER) AS point, {rd('t.lo + k.point * t.step', 3)} AS x,
       {rd('sum(b.c * exp(-pow((k.point - b.i) * t.step / t.h, 2) / 2)) / (t.n * t.h * sqrt(2 * pi()))', 10)} AS density
FROM t CROSS JOIN range(0, {KDE_POINTS}) k(point) JOIN b ON b.g = t.g GROUP BY t.g, k.point, t.lo, t.step, t.n, t.h""")
def agg_kde_1d(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    curve = D.kde_1d(o, "o_totalprice", ["o_orderpriority"], adjust=2.0, points=KDE_POINTS)
    return curve.select(
        "o_orderpriority", "point", (F.round("x", 3) + 0.0).alias("x"), (F.round("density", 10) + 0.0).alias("density")
    )


KDE_2D_SQL = """
WITH v AS (SELECT discount AS x, tax AS y FROM v_cov_x),
s AS (SELECT count(*) AS n, min(x) AS lx, (max(x) - min(x)) / 99 AS dx, min(y) AS ly, (max(y) - min(y)) / 99 AS dy,
  1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS hx,
  1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * pow(count(*), -0.2) AS hy FROM v),
p AS (SELECT (x - lx) / dx AS px, (y - ly) / dy AS py FROM v, s),
w AS (SELECT floor(px) + i AS i, floor(py) + j AS j, abs(1 - i - (px - floor(px))) * abs(1 - j - (py - floor(py))) AS c
      FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
c AS (SELECT i, j, sum(c) AS c FROM w GROUP BY 1, 2),
ax AS (SELECT j, k.k AS px, sum(c * exp(-pow((k.k - i) * dx / hx, 2) / 2)) AS c FROM c, s, range(0, 100) k(k) GROUP BY 1, 2)"""


@query("agg_kde_2d", KDE_2D_SQL + f"""
SELECT CAST(px AS INTEGER) AS px, CAST(k.k AS INTEGER) AS py, {rd('any_value(lx) + px * any_value(dx)', 8)} AS x,
       {rd('any_value(ly) + k.k * any_value(dy)', 8)} AS y,
       {rd('sum(c * exp(-pow((k.k - j) * dy / hy, 2) / 2)) / (any_value(n) * any_value(hx) * any_value(hy) * 2 * pi())', 4)} AS density
FROM ax, s, range(0, 100) k(k) GROUP BY px, k.k""")
def agg_kde_2d(spark, sf):
    out = D.kde_2d(V.covariates(spark, sf), "discount", "tax")
    return out.select(
        "px", "py", (F.round("x", 8) + 0.0).alias("x"), (F.round("y", 8) + 0.0).alias("y"), (F.round("density", 4) + 0.0).alias("density")
    )


MASSES = [0.1, 0.25, 0.5, 0.75, 0.9]
LEVELS_SQL = KDE_2D_SQL + f""",
z AS (SELECT CAST(px AS INTEGER) AS px, CAST(k.k AS INTEGER) AS py, any_value(lx) + px * any_value(dx) AS x, any_value(ly) + k.k * any_value(dy) AS y,
             sum(c * exp(-pow((k.k - j) * dy / hy, 2) / 2)) / (any_value(n) * any_value(hx) * any_value(hy) * 2 * pi()) AS z
      FROM ax, s, range(0, 100) k(k) GROUP BY px, k.k),
o AS (SELECT z, sum(w) OVER (ORDER BY z DESC) AS held, lead(z) OVER (ORDER BY z DESC) AS below, sum(w) OVER () AS whole FROM (SELECT z, z * count(*) AS w FROM z GROUP BY z)),
lv AS (SELECT mass, max((z + coalesce(below, 0)) / 2) AS level FROM o, (VALUES {", ".join(f"(CAST({m} AS DOUBLE))" for m in MASSES)}) m(mass) WHERE held >= mass * whole GROUP BY 1)"""


@query("agg_density_levels", LEVELS_SQL + f"""
SELECT mass, {rd('level', 4)} AS level, count(*) FILTER (z >= level) AS cells, {rd('sum(z) FILTER (z >= level) / sum(z)')} AS held FROM z, lv GROUP BY mass, level""")
def agg_density_levels(spark, sf):
    """Level per enclosed mass, the grid cells above it and the share they hold."""
    grid = stage(D.kde_2d(V.covariates(spark, sf), "discount", "tax"), "grid")
    levels = D.mass_levels(grid, MASSES)
    packed = levels.agg(F.collect_list(F.struct("mass", "level")).alias("l")).scalar()
    above = F.col("density") >= F.col("level")
    out = grid.withColumn("l", F.explode(packed)).select("density", "l.*").groupBy("mass", "level").agg(
        F.count_if(above).alias("cells"), (F.sum(F.when(above, F.col("density"))) / F.sum("density")).alias("held"))
    return out.select("mass", (F.round("level", 4) + 0.0).alias("level"), "cells", (F.round("held", 6) + 0.0).alias("held"))


@query("agg_density_lines", LEVELS_SQL + f""",
q AS (SELECT mass, level, a.px, a.py, a.x AS xa, b.x AS xb, a.y AS ya, d.y AS yd, a.z AS a, b.z AS b, c.z AS c, d.z AS d
      FROM z a JOIN z b ON b.px = a.px + 1 AND b.py = a.py JOIN z c ON c.px = a.px + 1 AND c.py = a.py + 1 JOIN z d ON d.px = a.px AND d.py = a.py + 1, lv),
e AS (SELECT *, CASE WHEN (a >= level) <> (b >= level) THEN [xa + (level - a) / (b - a) * (xb - xa), ya] END AS lo,
             CASE WHEN (b >= level) <> (c >= level) THEN [xb, ya + (level - b) / (c - b) * (yd - ya)] END AS ri,
             CASE WHEN (d >= level) <> (c >= level) THEN [xa + (level - d) / (c - d) * (xb - xa), yd] END AS hi,
             CASE WHEN (a >= level) <> (d >= level) THEN [xa, ya + (level - a) / (d - a) * (yd - ya)] END AS le FROM q),
f AS (SELECT *, list_filter([lo, ri, hi, le], lambda p: p IS NOT NULL) AS s, (a >= level) = ((a + b + c + d) / 4 >= level) AS odd FROM e),
g AS (SELECT mass, px, py, 0 AS part, CASE WHEN len(s) = 2 THEN s[1] WHEN odd THEN lo ELSE le END AS p, CASE WHEN len(s) = 2 THEN s[2] WHEN odd THEN ri ELSE lo END AS q FROM f WHERE len(s) > 1
      UNION ALL SELECT mass, px, py, 1, CASE WHEN odd THEN hi ELSE ri END, CASE WHEN odd THEN le ELSE hi END FROM f WHERE len(s) = 4)
SELECT mass, px, py, part, {rd('p[1]', 7)} AS x0, {rd('p[2]', 7)} AS y0, {rd('q[1]', 7)} AS x1, {rd('q[2]', 7)} AS y1 FROM g""")
def agg_density_lines(spark, sf):
    grid = stage(D.kde_2d(V.covariates(spark, sf), "discount", "tax"), "grid")
    lines = D.iso_lines(grid, D.mass_levels(grid, MASSES))
    return lines.select("mass", "px", "py", "part", *[(F.round(c, 7) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("agg_category_frequency", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS category_n
FROM orders GROUP BY 1, 2""")
def agg_category_frequency(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderpriority", "o_orderstatus")
    return D.category_frequency(o, "o_orderpriority", "o_orderstatus").orderBy(F.desc("category_n"), "o_orderpriority", "o_orderstatus")


# ---- windows


@query("win_group_total_share", f"""
SELECT unit, age, period, pop, {rd('pop / sum(pop) OVER (PARTITION BY period)', 9)} AS share FROM v_pop""")
def win_group_total_share(spark, sf):
    out = H.group_share(V.pop(spark, sf), ["period"], "pop", "share")
    return out.withColumn("share", F.round("share", 9) + 0.0).select("unit", "age", "period", "pop", "share")


def _cohort_panel(spark, sf):
    return V.coverage(spark, sf)


@query("win_cumsum_cohort", f"""
SELECT scenario, unit, cohort, period, {rd('doses')} AS doses, {rd('doses_cum')} AS doses_cum FROM v_cum""")
def win_cumsum_cohort(spark, sf):
    return rounded(_cohort_panel(spark, sf).select("scenario", "unit", "cohort", "period", "doses", "doses_cum"))


@query("win_lag_ratio", f"""
SELECT unit, age, period, {rd('coalesce(pop / lag(pop) OVER (PARTITION BY unit, period - age ORDER BY period), 1)')} AS ratio FROM v_pop""")
def win_lag_ratio(spark, sf):
    panel = V.pop(spark, sf).withColumn("cohort", F.col("period") - F.col("age"))
    out = panel.withColumn("ratio", H.lag_ratio("pop", ["unit", "cohort"], "period"))
    return rounded(out.select("unit", "age", "period", "ratio"))


@query("win_adjusted_cumsum", f"""
SELECT scenario, unit, cohort, period, {rd('ratio * doses_cum')} AS doses_adj, {rd('ratio * doses_cum / pop')} AS age_coverage FROM v_cum""")
def win_adjusted_cumsum(spark, sf):
    return rounded(_cohort_panel(spark, sf).select("scenario", "unit", "cohort", "period", "doses_adj", "age_coverage"))


@query("win_cumsum_unit", f"""
WITH c AS (SELECT unit, period, sum(events) OVER (PARTITION BY unit ORDER BY period) AS s FROM v_event WHERE period {SPAN})
SELECT unit, {', '.join(f'max(s) FILTER (period = {p}) AS c_{p}' for p in PERIODS)} FROM c GROUP BY 1""")
def win_cumsum_unit(spark, sf):
    ev = V.event(spark, sf).filter(F.col("period").isin(PERIODS))
    run = ev.withColumn("s", H.running_sum("events", ["unit"], "period"))
    return S.to_wide(run, ["unit"], "period", "s", PERIODS, "c_")


@query("win_minmax_levels", f"""
SELECT scenario, unit, period, {rd('coverage')} AS coverage, {rd('max(coverage) OVER f')} AS prefecture_max,
       {rd('min(coverage) OVER f')} AS prefecture_min, {rd('max(coverage) OVER v')} AS province_max, {rd('min(coverage) OVER v')} AS province_min
FROM v_unitcov WINDOW f AS (PARTITION BY scenario, prefecture, period), v AS (PARTITION BY scenario, province, period)""")
def win_minmax_levels(spark, sf):
    out = C.level_extremes(V.coverage_by_unit(spark, sf), {"prefecture": 4, "province": 3})
    return rounded(out.select("scenario", "unit", "period", "coverage", "prefecture_max", "prefecture_min", "province_max", "province_min"))


@query("win_var_levels", DISPERSION_SQL + f"""
SELECT unit, period, {rd('var_prefecture', 9)} AS var_prefecture, {rd('var_province', 9)} AS var_province FROM d""")
def win_var_levels(spark, sf):
    kept = unit_levels(V.coverage_valid(spark, sf).filter("scenario = 'pop'"), "unit", LEVELS)
    out = kept
    for name in ("prefecture", "province"):
        out = out.join(kept.groupBy("period", name).agg(F.var_samp("coverage").alias(f"var_{name}")), ["period", name])
    return rounded(out.select("unit", "period", "var_prefecture", "var_province"), 9)


@query("win_median_levels", f"""
SELECT o_orderkey, o_orderpriority, {rd('median(o_totalprice) OVER (PARTITION BY o_orderpriority)', 3)} AS median FROM orders""")
def win_median_levels(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    medians = Q.quantiles(o, "o_totalprice", {"median": 0.5}, ["o_orderpriority"])
    return rounded(o.join(medians, "o_orderpriority").select("o_orderkey", "o_orderpriority", "median"), 3)


@query("win_group_size", "SELECT unit, age, period, count(*) OVER (PARTITION BY unit, period - age) AS n FROM v_pop")
def win_group_size(spark, sf):
    panel = V.pop(spark, sf).withColumn("cohort", F.col("period") - F.col("age"))
    return panel.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("unit", "cohort"))).select("unit", "age", "period", "n")


@query("min_observations", """
SELECT unit, period, mon, events, count(events) OVER (PARTITION BY unit, period) AS n_obs FROM v_event_month
QUALIFY count(events) OVER (PARTITION BY unit, period) > 3""")
def min_observations_(spark, sf):
    return min_observations(V.event_month(spark, sf), ["unit", "period"], "events", 3)


@query("win_ntile", """
SELECT o_orderkey, CAST(ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS nt FROM orders""")
def win_ntile(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return Q.ntile_rank(o, ["o_totalprice", "o_orderkey"], 4, "nt").select("o_orderkey", "nt")


@query("win_ecdf", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rd('cume_dist() OVER (ORDER BY l_quantity)', 9)} AS rank FROM lineitem""")
def win_ecdf(spark, sf):
    """Few values, each on a large share of the lines."""
    li = V.scan(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(Q.ecdf_rank(li, "l_quantity", "rank").drop("l_quantity"), 9)


@query("zscore", f"""
SELECT unit, {rd('(wealth - avg(wealth) OVER ()) / stddev_samp(wealth) OVER ()')} AS wealth_s,
       {rd('(tax - avg(tax) OVER ()) / stddev_samp(tax) OVER ()')} AS tax_s FROM v_cov_x""")
def zscore(spark, sf):
    return rounded(H.zscores(V.covariates(spark, sf), ["wealth", "tax"]).select("unit", "wealth_s", "tax_s"))


@query("complement_extremes", f"""
WITH r AS (SELECT c_custkey, cume_dist() OVER (ORDER BY s) AS rank_high, cume_dist() OVER (ORDER BY b) AS rank_low FROM (
  SELECT c_custkey, c_acctbal AS b, sum(o_totalprice) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2))
SELECT c_custkey, {rd('rank_high')} AS rank_high, {rd('rank_low')} AS rank_low,
       CASE WHEN rank_high >= 0.9 AND rank_low <= 0.1 THEN 'inner' ELSE 'outer' END AS severity
FROM r WHERE rank_high >= 0.8 AND rank_low <= 0.2""")
def complement_extremes(spark, sf):
    from panelweave.plans.reports import extreme_units

    spent = V.scan(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("s")
    )
    rows = V.scan(spark, sf, "customer", "c_custkey", "c_acctbal").join(spent, "c_custkey")
    return rounded(extreme_units(rows, "s", "c_acctbal").select("c_custkey", "rank_high", "rank_low", "severity"))
