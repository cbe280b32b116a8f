"""Registry of (query, oracle) pairs and the shared views of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# every year of the supplied tables
PERIODS = list(range(1995, 2002))
SPAN = f"BETWEEN {PERIODS[0]} AND {PERIODS[-1]}"
AGES = [0, 1, 2, 3, 4, 5]
FACTOR = {0: 0.5, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}
LEVELS = {"region": 1, "province": 3, "prefecture": 4}
DIGITS = 6

VIEWS = f"""
v_unit AS (
  SELECT CAST(n_regionkey AS VARCHAR) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
         || CAST(s_suppkey % 3 AS VARCHAR) || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS unit,
         s_suppkey, s_name, n_regionkey, n_nationkey, n_name, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v_pop AS (
  SELECT unit, CAST(l_linenumber - 1 AS INTEGER) AS age, CAST(year(l_shipdate) AS INTEGER) AS period,
         sum(l_quantity) AS pop
  FROM lineitem JOIN v_unit ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
v_event_month AS (
  SELECT unit, CAST(year(l_shipdate) AS INTEGER) AS period, CAST(month(l_shipdate) AS INTEGER) AS mon,
         sum(l_quantity) AS events
  FROM lineitem JOIN v_unit ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY 1, 2, 3),
v_event AS (SELECT unit, period, sum(events) AS events FROM v_event_month GROUP BY 1, 2),
v_cases AS (
  SELECT unit, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS cases
  FROM lineitem JOIN v_unit ON l_suppkey = s_suppkey WHERE l_linestatus = 'F' GROUP BY 1, 2),
v_cov_x AS (
  SELECT unit, s_acctbal AS wealth, avg(l_discount) AS discount, avg(l_tax) AS tax,
         CAST(count(*) AS DOUBLE) AS lines
  FROM lineitem JOIN v_unit ON l_suppkey = s_suppkey GROUP BY 1, 2),
v_elig AS (
  SELECT unit, period, sum(pop) AS tot,
         CASE WHEN count(CASE WHEN age <= 5 THEN 1 END) = 6
              THEN sum(CASE WHEN age = 0 THEN 0.5 * pop WHEN age <= 5 THEN pop END) END AS eligible
  FROM v_pop GROUP BY 1, 2),
v_survey(scenario, age, num, den) AS (VALUES
  ('a', 0, 64.5, 420), ('a', 1, 129, 420), ('a', 2, 78, 420), ('a', 3, 33, 420), ('a', 4, 33, 420), ('a', 5, 33, 420),
  ('b', 0, 8, 80), ('b', 1, 21, 85), ('b', 2, 21, 85), ('b', 3, 20, 77), ('b', 4, 20, 77), ('b', 5, 20, 77)),
v_ref AS (
  SELECT 'a' AS scenario, min(unit) AS ref_unit, 1997 AS ref_period FROM v_unit
  UNION ALL SELECT 'b', max(unit), 1997 FROM v_unit),
v_weight_raw AS (
  SELECT scenario, p.age, sum(pop * num / den) AS c
  FROM v_pop p JOIN v_survey s USING (age) JOIN v_ref r USING (scenario)
  WHERE p.unit = r.ref_unit AND p.period = r.ref_period GROUP BY 1, 2),
v_weight AS (
  SELECT scenario, age, c / sum(c) OVER (PARTITION BY scenario) AS weight FROM v_weight_raw),
v_alloc AS (
  SELECT s.scenario, p.unit, p.period, p.age, p.period - p.age AS cohort, p.pop,
         CASE WHEN p.age = 0 THEN 0.5 ELSE 1.0 END AS factor,
         CASE WHEN s.scenario = 'pop' THEN (CASE WHEN p.age = 0 THEN 0.5 ELSE 1.0 END) * p.pop / e.eligible
              ELSE w.weight END AS weight,
         v.events
  FROM v_pop p JOIN v_elig e USING (unit, period) JOIN v_event v USING (unit, period)
  CROSS JOIN (VALUES ('pop'), ('a'), ('b')) s(scenario)
  LEFT JOIN v_weight w ON w.scenario = s.scenario AND w.age = p.age
  WHERE p.age <= 5 AND p.period {SPAN} AND e.eligible IS NOT NULL),
v_cum AS (
  SELECT *, events * weight AS doses,
         sum(events * weight) OVER w AS doses_cum,
         coalesce(pop / lag(pop) OVER w, 1.0) AS ratio
  FROM v_alloc WINDOW w AS (PARTITION BY scenario, unit, cohort ORDER BY period)),
v_cov AS (
  SELECT *, ratio * doses_cum AS doses_adj, ratio * doses_cum / pop AS age_coverage,
         sum(doses_cum) OVER c AS covered, sum(factor * pop) OVER c AS eligible_pop,
         sum(doses_cum) OVER c / sum(factor * pop) OVER c AS coverage
  FROM v_cum WHERE cohort BETWEEN period - 5 AND period WINDOW c AS (PARTITION BY scenario, unit, period)),
v_unitcov AS (
  SELECT scenario, unit, period, substr(unit, 1, 1) AS region, substr(unit, 1, 3) AS province,
         substr(unit, 1, 4) AS prefecture,
         max(covered) AS covered, max(eligible_pop) AS eligible_pop, max(coverage) AS coverage
  FROM v_cov GROUP BY 1, 2, 3),
v_valid AS (
  SELECT unit, period FROM v_unitcov GROUP BY 1, 2 HAVING max(coverage) <= 1)
"""


def with_views(sql: str) -> str:
    """Put the shared views in front of an oracle."""
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {VIEWS.strip()},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {VIEWS.strip()},\n{body[5:]}"
    return f"WITH {VIEWS.strip()}\n{body}"


def rd(expr: str, digits: int = DIGITS) -> str:
    """SQL text of a rounded double; adding zero removes the sign of a rounded -0."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Every double column rounded, as ``rd`` does in the oracle."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
