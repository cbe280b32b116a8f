"""Joins, key membership, recoding and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.text import unit_levels
from panelweave.operators import keys as K, shape as S
from panelweave.plans.events import code_repair as repair, judge_evidence, repair_evidence
from panelweave.plans.population import pop_harmonise as harmonise
from panelweave.session import stage
from panelweave.sources.tables import literal_table
from workload import views as V
from workload.registry import AGES, PERIODS, SPAN, query, rd, rounded


def _totals(spark, sf):
    return V.pop(spark, sf).groupBy("unit", "period").agg(F.sum("pop").alias("pop"))


@query("join_left_multi", """
SELECT p.unit, p.period, p.pop, e.events FROM (SELECT unit, period, sum(pop) AS pop FROM v_pop GROUP BY 1, 2) p
LEFT JOIN (SELECT * FROM v_event WHERE events > 60) e ON p.unit = e.unit AND p.period = e.period""")
def join_left_multi(spark, sf):
    return _totals(spark, sf).join(V.event(spark, sf).filter("events > 60"), ["unit", "period"], "left")


@query("join_left_rename_key", """
SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey""")
def join_left_rename_key(spark, sf):
    nation = V.scan(spark, sf, "nation").filter("n_regionkey <> 4").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = V.scan(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    return customer.join(nation, "c_nationkey", "left").select("c_custkey", "c_name", "n_name")


@query("join_dim_lookup", """
SELECT unit, period, events, r_name AS region_name FROM v_event LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = substr(unit, 1, 1)""")
def join_dim_lookup(spark, sf):
    names = V.scan(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("region"), F.col("r_name").alias("region_name")
    )
    return unit_levels(V.event(spark, sf), "unit", {"region": 1}).join(names, "region", "left").drop("region")


# the supplied years and one without facts
SPINE = [PERIODS[0] - 1, *PERIODS]
_SPINE_SQL = ", ".join(f"({p})" for p in SPINE)


@query("join_right_spine", f"""
SELECT u.unit, CAST(p.period AS INTEGER) AS period, e.events FROM v_unit u CROSS JOIN (VALUES {_SPINE_SQL}) p(period)
LEFT JOIN v_event e ON e.unit = u.unit AND e.period = p.period""")
def join_right_spine(spark, sf):
    spine = S.grid(V.units(spark, sf).select("unit"), period=SPINE)
    return S.complete(spine, V.event(spark, sf), ["unit", "period"])


@query("join_after_filter_inner", """
SELECT v.unit, v.period, v.events, e.eligible FROM v_event v JOIN (
  SELECT unit, period, CASE WHEN tot >= 1000 THEN eligible END AS eligible FROM v_elig) e USING (unit, period)
WHERE e.eligible IS NOT NULL""")
def join_after_filter_inner(spark, sf):
    from panelweave.plans.population import eligible_population
    from workload.registry import FACTOR

    elig = eligible_population(V.pop(spark, sf), FACTOR)
    some = elig.select("unit", "period", F.when(F.col("tot") >= 1000, F.col("eligible")).alias("eligible"))
    return V.event(spark, sf).join(some, ["unit", "period"]).filter("eligible IS NOT NULL")


@query("join_name_collision", """
SELECT s.s_suppkey AS code, s.s_name AS unit_name, n.n_name AS province_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey""")
def join_name_collision(spark, sf):
    left = V.scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("key"), F.col("s_name").alias("name"))
    right = V.scan(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    joined = left.alias("x").join(right.alias("y"), "key")
    return joined.select("code", F.col("x.name").alias("unit_name"), F.col("y.name").alias("province_name"))


@query("semi_anti", """
SELECT c_custkey, 'with large order' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
UNION ALL SELECT c_custkey, 'without order' FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def semi_anti(spark, sf):
    c = V.scan(spark, sf, "customer", "c_custkey")
    o = V.scan(spark, sf, "orders", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    large = K.members(c, o.filter("o_totalprice > 450000"), ["c_custkey"]).withColumn("kind", F.lit("with large order"))
    return large.unionByName(K.non_members(c, o, ["c_custkey"]).withColumn("kind", F.lit("without order")))


@query("cross_grid", f"""
SELECT unit, CAST(a.age AS INTEGER) AS age, CAST(p.period AS INTEGER) AS period FROM (SELECT DISTINCT unit FROM v_event)
CROSS JOIN range(0, 6) a(age) CROSS JOIN range({PERIODS[0]}, {PERIODS[-1] + 1}) p(period)""")
def cross_grid(spark, sf):
    return S.grid(V.event(spark, sf).select("unit").distinct(), age=AGES, period=PERIODS)


@query("unique_fuzzy_match", """
WITH c AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand || '/' || p_size AS block, p_type FROM part),
s AS (SELECT 'S' || p_partkey AS code, split_part(p_name, ' ', 2) AS name, p_brand || '/' || p_size AS block FROM part),
m AS (SELECT s.code AS "from", min(c.code) AS "to", min(c.p_type) AS p_type FROM s JOIN c ON s.block = c.block AND contains(c.name, substr(s.name, 1, 2))
      GROUP BY 1 HAVING count(*) = 1)
SELECT "from", "to" FROM m WHERE p_type <> 'ECONOMY'""")
def unique_fuzzy_match(spark, sf):
    part = V.scan(spark, sf, "part")
    block = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("block")
    dim = part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), block)
    lost = part.select(
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("code"),
        F.element_at(F.split("p_name", " "), 2).alias("name"), block,
    )
    black = part.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("code"))
    return K.unique_fuzzy_match(lost, dim, blacklist=black)


@query("name_backfill", """
WITH one AS (SELECT o_custkey AS code, o_orderstatus AS place, o_orderpriority AS name,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_totalprice > 450000)
SELECT c_custkey AS code, one.place, CASE WHEN one.code IS NOT NULL THEN one.name ELSE c_mktsegment END AS name
FROM customer LEFT JOIN one ON one.code = c_custkey AND i = 1""")
def name_backfill(spark, sf):
    c = V.scan(spark, sf, "customer")
    one = V.scan(spark, sf, "orders").filter("o_totalprice > 450000").select(
        F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("place"),
        F.col("o_orderpriority").alias("name"),
    )
    two = c.select(F.col("c_custkey").alias("code"), F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("name"))
    return K.name_backfill(c.select(F.col("c_custkey").alias("code")), "code", [one, two], "row", ["place", "name"])


PAIR_SQL = """
known AS (SELECT 'C' || c_custkey AS code FROM customer WHERE c_mktsegment <> 'BUILDING'),
pairs AS (SELECT o_orderkey AS "row", 'C' || o_custkey AS ver1, 'C' || (o_custkey + length(o_orderpriority)) AS ver2 FROM orders),
flag AS (SELECT *, ver1 IN (SELECT code FROM known) AS k1, ver2 IN (SELECT code FROM known) AS k2 FROM pairs),
moved AS (SELECT "row", CASE WHEN k1 THEN ver2 ELSE ver1 END AS "from", CASE WHEN k1 THEN ver1 ELSE ver2 END AS "to" FROM flag WHERE k1 <> k2),
mapping AS (SELECT "from", min_by("to", "row") AS "to" FROM moved GROUP BY 1)"""


def _mapping(spark, sf):
    c = V.scan(spark, sf, "customer", "c_custkey", "c_mktsegment")
    known = c.filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"))
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    pairs = o.select(
        F.col("o_orderkey").alias("row"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ver1"),
        F.concat(F.lit("C"), (F.col("o_custkey") + F.length("o_orderpriority")).cast("string")).alias("ver2"),
    )
    return K.recode_pairs(pairs, known)


@query("code_recode_pairs", f'WITH {PAIR_SQL} SELECT "from", "to" FROM mapping')
def code_recode_pairs(spark, sf):
    return _mapping(spark, sf)


@query("recode_apply", f"""
WITH {PAIR_SQL},
f AS (SELECT 'C' || o_custkey AS code, CAST(year(o_orderdate) AS INTEGER) AS period, o_totalprice FROM orders)
SELECT coalesce(m."to", f.code) AS code, period, {rd('sum(o_totalprice)', 2)} AS value FROM f LEFT JOIN mapping m ON m."from" = f.code
GROUP BY 1, 2""")
def recode_apply(spark, sf):
    o = V.scan(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    facts = o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), F.year("o_orderdate").alias("period"),
        F.col("o_totalprice").alias("value"),
    )
    return rounded(K.recode_apply(facts, "code", _mapping(spark, sf), ["code", "period"], "value"), 2)


@query("unmatched_keys", """
SELECT DISTINCT 'C' || o_custkey AS code FROM orders WHERE 'C' || o_custkey NOT IN (
  SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 0)""")
def unmatched_keys(spark, sf):
    facts, dim = _order_codes(spark, sf)
    return K.unmatched_keys(facts, dim, "code")


def _order_codes(spark, sf):
    o = V.scan(spark, sf, "orders", "o_custkey", "o_totalprice")
    facts = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), F.col("o_totalprice").alias("value"))
    c = V.scan(spark, sf, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0")
    return facts, c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"))


@query("located_share", f"""
WITH f AS (SELECT o_totalprice AS value, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders)
SELECT {rd('sum(CASE WHEN known THEN value END)', 2)} AS located, {rd('sum(value)', 2)} AS total,
       {rd('1 - sum(CASE WHEN known THEN value END) / sum(value)')} AS unlocated_share FROM f""")
def located_share(spark, sf):
    facts, dim = _order_codes(spark, sf)
    out = K.located_share(facts, dim, "code", "value")
    return out.select(
        (F.round("located", 2) + 0.0).alias("located"), (F.round("total", 2) + 0.0).alias("total"),
        (F.round("unlocated_share", 6) + 0.0).alias("unlocated_share"),
    )


# Parts stand for places: one type of part is missing from the dimension, and its lines must be relocated.
def _repair_inputs(spark, sf):
    part = V.scan(spark, sf, "part")
    code = F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code")
    block = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"))
    dim = part.filter("p_type <> 'SMALL'").select(code, F.col("p_name").alias("name"), block.alias("block"))
    lines = V.scan(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_shipdate")
    facts = lines.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"), F.year("l_shipdate").alias("period"), F.col("l_quantity").alias("events")
    )
    one = part.filter("p_size >= 25").select(
        code, F.col("p_partkey").alias("row"), F.col("p_name").alias("name"), block.alias("place"), F.col("p_type").alias("area")
    )
    two = part.select(code, F.col("p_partkey").alias("row"), F.col("p_name").alias("name"), block.alias("area"))
    places = part.select(block.alias("place"), block.alias("block")).distinct()
    overrides = literal_table(
        spark, [("place", "Brand#3/30", "Brand#4/30"), ("area", "Brand#7/10", "Brand#7/11")], "field string, match string, block string"
    )
    black = part.filter("p_type = 'ECONOMY'").select(code)
    return facts, dim, [one, two], places, overrides, black


def _repair(spark, sf):
    return repair(*_repair_inputs(spark, sf))


REPAIR_SQL = """
dim AS (SELECT 'P' || p_partkey AS code, p_name AS name, p_brand || '/' || p_size AS block, p_type FROM part WHERE p_type <> 'SMALL'),
facts AS (SELECT 'P' || l_partkey AS code, CAST(year(l_shipdate) AS INTEGER) AS period, sum(l_quantity) AS events FROM lineitem GROUP BY 1, 2),
lost AS (SELECT DISTINCT code FROM facts WHERE code NOT IN (SELECT code FROM dim)),
blocked AS (SELECT lost.code, p_name AS name,
            CASE WHEN p_size < 25 THEN (CASE WHEN p_brand || '/' || p_size = 'Brand#7/10' THEN 'Brand#7/11' END)
                 WHEN p_brand || '/' || p_size = 'Brand#3/30' THEN 'Brand#4/30' ELSE p_brand || '/' || p_size END AS block
            FROM lost JOIN part ON 'P' || p_partkey = lost.code),
m AS (SELECT b.code AS "from", min(d.code) AS "to", min(d.p_type) AS p_type FROM blocked b
      JOIN dim d ON d.block = b.block AND contains(d.name, substr(b.name, 1, 2)) GROUP BY 1 HAVING count(*) = 1),
mapping AS (SELECT "from", "to" FROM m WHERE p_type <> 'ECONOMY'),
repaired AS (SELECT coalesce(m."to", f.code) AS code, period, sum(events) AS events FROM facts f LEFT JOIN mapping m ON m."from" = f.code GROUP BY 1, 2)"""


@query("code_repair", f"WITH {REPAIR_SQL} SELECT code, period, events FROM repaired")
def code_repair(spark, sf):
    return _repair(spark, sf)[0]


EVIDENCE_SQL = REPAIR_SQL + """,
e AS (SELECT b.code, p_size >= 25 AS one, b.block, p_brand || '/' || p_size AS own, count(d.code) AS n, min(d.code) AS t, min(d.p_type) AS p_type
      FROM blocked b JOIN part ON 'P' || p_partkey = b.code LEFT JOIN dim d ON d.block = b.block AND contains(d.name, substr(b.name, 1, 2)) GROUP BY 1, 2, 3, 4)"""


@query("code_repair_audit", f"""
WITH {EVIDENCE_SQL}
SELECT code AS "from", CASE WHEN n = 1 AND p_type <> 'ECONOMY' THEN t END AS "to", CASE WHEN n = 1 AND p_type <> 'ECONOMY' THEN 'name' ELSE 'unresolved' END AS rule,
       CASE WHEN one THEN 1 ELSE 2 END AS source, CASE WHEN block IS NULL THEN NULL WHEN NOT one THEN 'area override' WHEN own = 'Brand#3/30' THEN 'place override' ELSE 'place' END AS block_by,
       n AS n_candidates, CASE WHEN block IS NULL THEN 'no block' WHEN n = 0 THEN 'no candidate' WHEN n > 1 THEN 'several candidates'
                               WHEN p_type = 'ECONOMY' THEN 'blacklisted' ELSE 'match' END AS outcome FROM e""")
def code_repair_audit(spark, sf):
    """How each lost code was placed, or what was missing."""
    facts, dim, names, places, overrides, black = _repair_inputs(spark, sf)
    lost = K.unmatched_keys(facts, dim, "code")
    return judge_evidence(stage(repair_evidence(lost, dim, names, places, overrides, black), "evidence"))[0]


MOVED = [("place", f"Brand#{b}/{size}", f"Brand#{b + 1}/{size}") for b in (1, 2, 3, 4) for size in range(25, 51)]


@query("code_repair_conflicts", """
WITH dim AS (SELECT 'P' || p_partkey AS code, p_name AS name, p_brand || '/' || p_size AS block, p_type FROM part WHERE p_type <> 'SMALL'),
lost AS (SELECT DISTINCT 'P' || l_partkey AS code FROM lineitem WHERE 'P' || l_partkey NOT IN (SELECT code FROM dim)),
w AS (SELECT lost.code, p_name AS name, p_brand || '/' || p_size AS own,
             'Brand#' || (CAST(p_brand[7:] AS INTEGER) + 1) || '/' || p_size AS moved FROM lost JOIN part ON 'P' || p_partkey = lost.code
      WHERE p_size BETWEEN 25 AND 50 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')),
c AS (SELECT w.code, k.kind, k.block, count(d.code) AS n, min(d.code) AS t, min(d.p_type) AS p_type
      FROM w, (VALUES ('own'), ('moved')) v(kind0), LATERAL (SELECT kind0 AS kind, CASE WHEN kind0 = 'own' THEN own ELSE moved END AS block) k
      LEFT JOIN dim d ON d.block = k.block AND contains(d.name, substr(w.name, 1, 2)) GROUP BY 1, 2, 3),
m AS (SELECT *, CASE WHEN n = 1 AND p_type <> 'ECONOMY' THEN t END AS target FROM c)
SELECT o.code AS "from", m.target AS chosen, o.target AS "to", 1 AS source, 'place' AS block_by, o.block
FROM m o JOIN m ON m.code = o.code AND m.kind = 'moved' WHERE o.kind = 'own' AND o.target IS NOT NULL AND m.target IS DISTINCT FROM o.target""")
def code_repair_conflicts(spark, sf):
    """Codes that a wide set of overrides moves away from where their own place leads."""
    facts, dim, names, places, _, black = _repair_inputs(spark, sf)
    lost = K.unmatched_keys(facts, dim, "code")
    overrides = literal_table(spark, MOVED, "field string, match string, block string")
    return judge_evidence(stage(repair_evidence(lost, dim, names, places, overrides, black), "evidence"))[1]


@query("code_repair_located", f"""
WITH {REPAIR_SQL}
SELECT sum(events) FILTER (code IN (SELECT code FROM dim)) AS located, sum(events) AS total,
       {rd('1 - sum(events) FILTER (code IN (SELECT code FROM dim)) / sum(events)')} AS unlocated_share FROM repaired""")
def code_repair_located(spark, sf):
    return rounded(_repair(spark, sf)[2])


# Two sources with different columns; some units change their code between periods.
_WHOLE = " + ".join(f"p{p}" for p in PERIODS)
_SUMS = ", ".join(f"sum(p{p}) AS p{p}" for p in PERIODS)
HARMONISE_SQL = f"""
raw AS (SELECT substr(unit, 1, 13) || CASE WHEN period >= 1998 AND n_acct < 2000 THEN 'x' ELSE substr(unit, 14, 1) END AS unit, age, period, pop
        FROM (SELECT p.*, u.s_acctbal AS n_acct FROM v_pop p JOIN v_unit u USING (unit))
        WHERE period {SPAN} AND NOT (n_acct > 9000 AND period = 1997 AND age = 2)),
pairs AS (SELECT row_number() OVER (ORDER BY unit) AS "row", substr(unit, 1, 13) || 'x' AS ver1, unit AS ver2 FROM v_unit WHERE s_acctbal < 2000),
mapping AS (SELECT ver1 AS "from", min_by(ver2, ver2) AS "to" FROM pairs GROUP BY 1),
allowed AS (SELECT substr(unit, 1, 3) AS province FROM v_unit GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT unit, age, {', '.join(f'sum(pop) FILTER (period = {p}) AS p{p}' for p in PERIODS)}
      FROM raw WHERE substr(unit, 1, 3) IN (SELECT province FROM allowed) GROUP BY 1, 2),
whole AS (SELECT * FROM w WHERE {_WHOLE} IS NOT NULL),
part_ AS (SELECT coalesce(m."to", unit) AS unit, age, {_SUMS} FROM w
         LEFT JOIN mapping m ON m."from" = unit WHERE {_WHOLE} IS NULL GROUP BY 1, 2),
t AS (SELECT unit, age, {_SUMS} FROM (
      SELECT * FROM whole UNION ALL SELECT * FROM part_ WHERE {_WHOLE} IS NOT NULL) GROUP BY 1, 2)
{" UNION ALL ".join(f"SELECT unit, substr(unit, 1, 3) AS province, age, {p} AS period, p{p} AS pop FROM t" for p in PERIODS)}"""


@query("pop_harmonise", f"WITH {HARMONISE_SQL}")
def pop_harmonise(spark, sf):
    """Poor units appear under an old code from 1998 on; rich units miss one cell and drop out for that age."""
    u = V.units(spark, sf).select("unit", "s_acctbal")
    raw = V.pop(spark, sf).filter(F.col("period").isin(PERIODS)).join(u, "unit").filter(
        ~((F.col("s_acctbal") > 9000) & (F.col("period") == 1997) & (F.col("age") == 2))
    )
    old = F.concat(F.substring("unit", 1, 13), F.lit("x"))
    recent = raw.filter("period >= 1998").withColumn("unit", F.when(F.col("s_acctbal") < 2000, old).otherwise(F.col("unit")))
    sources = [raw.filter("period < 1998").select("unit", "age", "period", "pop", F.lit("a").alias("name")),
               recent.select("unit", "age", "period", "pop")]
    pairs = u.filter("s_acctbal < 2000").select(F.col("unit").alias("row"), old.alias("ver1"), F.col("unit").alias("ver2"))
    allowed = unit_levels(u, "unit", {"province": 3}).groupBy("province").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    known = u.select(F.col("unit").alias("code"))
    return harmonise(sources, PERIODS, allowed, pairs, known, level=("province", 3))
