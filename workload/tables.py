"""Scans, sinks, projections, filters, set operations, reshaping, sorting and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from panelweave.functions import nulls as N, text as T
from panelweave.operators import keys as K, shape as S
from panelweave.operators.describe import category_order as category_order_of
from panelweave.operators.ranks import row_positions
from panelweave.plans.coverage import eligible_cohorts
from panelweave.session import stage_path
from panelweave.sources import sheets as SH, snapshots as SN, tables as IO
from workload import views as V
from workload.registry import PERIODS, SPAN, query, rd, rounded


# ---- scans and sinks


@query("scan_dims", """
SELECT unit, s_name AS name, substr(unit, 1, 1) AS region, substr(unit, 1, 3) AS province, n_name AS province_name FROM v_unit""")
def scan_dims(spark, sf):
    dims = T.unit_levels(V.units(spark, sf), "unit", {"region": 1, "province": 3})
    return dims.select("unit", F.col("s_name").alias("name"), "region", "province", F.col("n_name").alias("province_name"))


def _raw_customers(spark, sf):
    """A delimited text file with header lines and '-' for a missing balance, read back as text."""
    path = stage_path(spark, "raw")
    c = V.scan(spark, sf, "customer")
    dirty = c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_acctbal") < 0, F.lit("-")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        "c_mktsegment",
    )
    IO.write_csv(dirty, path)
    return IO.scan_text(spark, path, ["c0", "c1", "c2", "c3", "c4"])


PER_BOOK = 20_000


def _workbooks(spark, sf):
    """(path, content): customers in workbooks of ``PER_BOOK`` keys at most, with a sheet of notes before the data and two header rows.

    Negative balances are '-', those under -900 a text that is no number; rows without a segment end early.
    """
    c = V.scan(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    dealt = c.withColumn("book", F.floor(F.col("c_custkey") / PER_BOOK))

    workbook = SH.workbook

    def build(pdf):
        import pandas as pd

        rows = [["code", "name", "nation", "balance", "segment"], ["id", None, "key", "currency", "text"]]
        for code, name, nation, balance, segment in zip(pdf.c_custkey, pdf.c_name, pdf.c_nationkey, pdf.c_acctbal, pdf.c_mktsegment):
            shown = "n/a" if balance < -900 else "-" if balance < 0 else float(balance)
            rows.append([int(code), name, int(nation), shown, segment])
        content = workbook({"notes": [["customers", len(pdf)]], "data & keys": rows})
        return pd.DataFrame({"path": [f"book-{pdf.book.iloc[0]}"], "content": [content]})

    path = stage_path(spark, "books")
    dealt.groupBy("book").applyInPandas(build, "path string, content binary").write.parquet(path)
    return spark.read.parquet(path)


@query("scan_excel", """
SELECT c_custkey AS code, c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment AS segment,
       CASE WHEN c_acctbal < -900 THEN 'balance' ELSE '' END AS failed
FROM customer""")
def scan_excel(spark, sf):
    """Second sheet of each workbook by name, headers left out by row number, cells by position; a cell that does not parse is named."""
    raw = SH.named_cells(SH.sheet_rows(_workbooks(spark, sf), ["data & keys"]), ["c0", "c1", "c2", "c3", "c4"], header_rows=2)
    kinds = {"code": "bigint", "name": "string", "balance": "double", "segment": "string"}
    return IO.typed(raw, kinds, positions=[0, 1, 3, 4], failed="failed")


@query("scan_excel_sheets", f"""
SELECT 'data & keys' AS sheet, count(*) + 2 * count(DISTINCT c_custkey // {PER_BOOK}) AS n_rows, count(DISTINCT c_custkey // {PER_BOOK}) AS books FROM customer
UNION ALL SELECT 'notes', count(DISTINCT c_custkey // {PER_BOOK}), count(DISTINCT c_custkey // {PER_BOOK}) FROM customer""")
def scan_excel_sheets(spark, sf):
    rows = SH.sheet_rows(_workbooks(spark, sf))
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("path").alias("books"))


@query("drop_first_row", "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name FROM customer")
def drop_first_row(spark, sf):
    raw = _raw_customers(spark, sf)
    return raw.filter(F.col("c0") != "c_custkey").select(F.col("c0").alias("code"), F.col("c1").alias("name"))


@query("scan_snapshot", "SELECT unit, age, period, pop FROM v_pop")
def scan_snapshot(spark, sf):
    path = stage_path(spark, "pop")
    IO.write_snapshot(V.pop(spark, sf), path)
    return IO.read_snapshot(spark, path)


@query("sink_snapshot", "SELECT period, count(*) AS n, sum(pop) AS pop FROM v_pop GROUP BY period")
def sink_snapshot(spark, sf):
    path = stage_path(spark, "pop-by-period")
    IO.write_snapshot(V.pop(spark, sf), path, ["period"])
    return IO.read_snapshot(spark, path).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop"))


@query("sink_snapshot_refresh", """
SELECT period, count(*) AS n, sum(CASE WHEN period = 1998 THEN 2 * pop ELSE pop END) AS pop FROM v_pop WHERE period <> 1999 OR age > 2 GROUP BY period""")
def sink_snapshot_refresh(spark, sf):
    """One period is replaced by other values and one by fewer rows; the others keep their files. The second run of a refresh changes nothing."""
    path = stage_path(spark, "refreshed")
    SN.refresh_snapshot(V.pop(spark, sf), path, ["period"], "first")
    changed = V.pop(spark, sf).filter("period = 1998 OR period = 1999 AND age > 2").withColumn("pop", F.when(F.col("period") == 1998, 2 * F.col("pop")).otherwise(F.col("pop")))
    for _ in range(2):
        SN.refresh_snapshot(changed, path, ["period"], "second")
    return SN.read_refreshed(spark, path).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("pop").alias("pop"))


@query("sink_csv", "SELECT substr(unit, 1, 3) AS province, period, sum(pop) AS pop FROM v_pop GROUP BY 1, 2")
def sink_csv(spark, sf):
    path = stage_path(spark, "report")
    report = V.pop(spark, sf).groupBy(F.substring("unit", 1, 3).alias("province"), "period").agg(F.sum("pop").alias("pop"))
    IO.write_csv(report, path, order=["province", "period"], single_file=True)
    return IO.read_csv(spark, path, "province string, period int, pop double")


# Region labels of the supplied tables and their display order.
REGION_LABELS = [("0", "Africa", 1), ("1", "America", 2), ("2", "Asia", 3), ("3", "Europe", 4), ("4", "Middle East", 5)]


@query("literal_table", """
WITH labels(region, label, sort_key) AS (VALUES ('0', 'Africa', 1), ('1', 'America', 2), ('2', 'Asia', 3), ('3', 'Europe', 4),
  ('4', 'Middle East', 5))
SELECT region, label, sort_key, count(*) AS units FROM v_unit JOIN labels ON region = substr(unit, 1, 1) GROUP BY 1, 2, 3""")
def literal_table(spark, sf):
    labels = IO.literal_table(spark, REGION_LABELS, "region string, label string, sort_key int")
    per = V.units(spark, sf).groupBy(F.substring("unit", 1, 1).alias("region")).agg(F.count(F.lit(1)).alias("units"))
    return per.join(labels, "region")


# ---- projections and filters


@query("project", "SELECT s_suppkey AS code, s_acctbal AS balance, s_name AS name FROM supplier")
def project(spark, sf):
    return V.scan(spark, sf, "supplier").drop("s_nationkey").withColumnsRenamed(
        {"s_suppkey": "code", "s_acctbal": "balance", "s_name": "name"}
    ).select("code", "balance", "name")


@query("select_by_pattern", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_pattern(spark, sf):
    part = V.scan(spark, sf, "part")
    return part.select(*S.pick(part, starts="p_", ends=("key", "size", "price")))


@query("derive", f"""
SELECT p_partkey, {rd('p_retailprice / p_size')} AS unit_price, {rd('p_retailprice / p_size * 12')} AS yearly,
       {rd('p_retailprice / p_size * 12 - p_retailprice')} AS gain FROM part""")
def derive(spark, sf):
    part = V.scan(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    out = part.withColumn("unit_price", F.try_divide("p_retailprice", "p_size"))
    out = out.withColumn("yearly", F.col("unit_price") * 12).withColumn("gain", F.col("yearly") - F.col("p_retailprice"))
    return rounded(out.select("p_partkey", "unit_price", "yearly", "gain"))


@query("filter_pred", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
WHERE (o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR NOT (o_orderstatus <> 'P')""")
def filter_pred(spark, sf):
    o = V.scan(spark, sf, "orders")
    keep = (F.col("o_totalprice") > 100000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.filter(keep | ~(F.col("o_orderstatus") != "P")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("cohort_eligibility", f"""
SELECT unit, age, period, period - age AS cohort, pop FROM v_pop
WHERE period {SPAN} AND period - age BETWEEN period - 5 AND period""")
def cohort_eligibility(spark, sf):
    panel = V.pop(spark, sf).filter(F.col("period").isin(PERIODS)).withColumn("cohort", F.col("period") - F.col("age"))
    return eligible_cohorts(panel, "period", 5)


NULLED_CUSTOMER = """
n AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
             CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer)"""


def _nulled_customer(spark, sf):
    c = V.scan(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    return c.select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )


@query("complete_cases", f"WITH {NULLED_CUSTOMER} SELECT * FROM n WHERE balance IS NOT NULL AND segment IS NOT NULL")
def complete_cases(spark, sf):
    return N.complete_cases(_nulled_customer(spark, sf))


@query("incomplete_cases", f"WITH {NULLED_CUSTOMER} SELECT * FROM n WHERE balance IS NULL OR segment IS NULL")
def incomplete_cases(spark, sf):
    return N.complete_cases(_nulled_customer(spark, sf), keep="incomplete")


@query("replace_null", f"""
WITH {NULLED_CUSTOMER}
SELECT c_custkey, coalesce(balance, 0) AS balance, coalesce(segment, 'none') AS segment,
       nullif(segment, 'MACHINERY') AS known_segment FROM n""")
def replace_null(spark, sf):
    c = _nulled_customer(spark, sf).withColumn("known_segment", F.nullif("segment", F.lit("MACHINERY")))
    return c.fillna({"balance": 0.0, "segment": "none"})


@query("n_isna", f"""
WITH {NULLED_CUSTOMER}
SELECT balance IS NULL AS no_balance, segment IS NULL AS no_segment, count(*) AS n FROM n GROUP BY 1, 2""")
def n_isna(spark, sf):
    return _nulled_customer(spark, sf).groupBy(
        F.col("balance").isNull().alias("no_balance"), F.col("segment").isNull().alias("no_segment")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("pull_keys", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)""")
def pull_keys(spark, sf):
    urgent = V.scan(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_totalprice").filter(
        "o_orderpriority = '1-URGENT' AND o_totalprice > 400000"
    )
    listed = urgent.select(F.col("o_custkey").alias("c_custkey")).distinct()
    return K.members(V.scan(spark, sf, "customer", "c_custkey", "c_name"), listed, ["c_custkey"])


@query("subset_unit", """
SELECT unit, age, period, pop FROM v_pop WHERE unit = (SELECT min(unit) FROM v_unit) AND period = 1997 AND age <= 5""")
def subset_unit(spark, sf):
    first = V.units(spark, sf).agg(F.min("unit")).scalar()
    return V.pop(spark, sf).filter((F.col("unit") == first) & (F.col("period") == 1997) & (F.col("age") <= 5))


@query("drop_unit_aggregates", "SELECT unit, period, sum(pop) AS pop FROM v_pop GROUP BY 1, 2")
def drop_unit_aggregates(spark, sf):
    """Roll-up rows are added under zero-padded codes and "0", then removed by their code segments."""
    per = V.pop(spark, sf).groupBy("unit", "period").agg(F.sum("pop").alias("pop"))
    rolled = [
        per.groupBy(F.rpad(F.substring("unit", 1, n), 14, "*").alias("unit"), "period").agg(F.sum("pop").alias("pop"))
        for n in (1, 3, 4)
    ]
    whole = per.groupBy("period").agg(F.sum("pop").alias("pop")).withColumn("unit", F.lit("0"))
    mixed = S.union_named(per, *rolled, whole)
    return mixed.filter((F.col("unit") != "0") & (T.code_segment("unit", 5, 14) != "*" * 10))


@query("region_membership", """
WITH w AS (SELECT substr(unit, 1, 3) AS province FROM v_unit GROUP BY 1 HAVING count(*) >= 4),
b AS (SELECT substr(unit, 1, 3) AS province FROM v_unit GROUP BY 1 HAVING avg(s_acctbal) < 3500)
SELECT unit, s_name FROM v_unit WHERE substr(unit, 1, 3) IN (SELECT province FROM w)
AND substr(unit, 1, 3) NOT IN (SELECT province FROM b)""")
def region_membership(spark, sf):
    u = T.unit_levels(V.units(spark, sf), "unit", {"province": 3})
    per = u.groupBy("province").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("balance"))
    kept = K.non_members(K.members(u, per.filter("n >= 4"), ["province"]), per.filter("balance < 3500"), ["province"])
    return kept.select("unit", "s_name")


@query("range_filter_valid", f"""
SELECT unit, period, {rd('events / eligible * 6')} AS cov FROM v_event JOIN v_elig USING (unit, period)
WHERE eligible IS NOT NULL AND unit NOT IN (
  SELECT unit FROM v_event JOIN v_elig USING (unit, period) WHERE events / eligible * 6 > 1)""")
def range_filter_valid(spark, sf):
    from panelweave.plans.population import eligible_population
    from workload.registry import FACTOR

    elig = eligible_population(V.pop(spark, sf), FACTOR)
    cov = V.event(spark, sf).join(elig, ["unit", "period"]).select(
        "unit", "period", (F.col("events") / F.col("eligible") * 6).alias("cov")
    )
    return rounded(K.drop_violating_units(cov, ["unit"], (F.col("cov") < 0) | (F.col("cov") > 1)))


@query("literature_filter", """
SELECT p_partkey AS study_row, p_brand AS study, CAST(floor(p_size / 10) AS BIGINT) AS age_lo,
       CAST(floor(p_size / 10) + length(p_type) - 4 AS BIGINT) AS age_hi
FROM part WHERE NOT (floor(p_size / 10) = 0 AND floor(p_size / 10) + length(p_type) - 4 IN (3, 4))
AND p_brand IN ('Brand#2', 'Brand#17')""")
def literature_filter(spark, sf):
    """Studies over the whole age range are removed and two study ids kept; no split into lists."""
    lo = F.floor(F.col("p_size") / 10)
    part = V.scan(spark, sf, "part", "p_partkey", "p_brand", "p_size", "p_type")
    rows = part.select(
        F.col("p_partkey").alias("study_row"), F.col("p_brand").alias("study"), lo.alias("age_lo"),
        (lo + F.length("p_type") - 4).alias("age_hi"),
    )
    whole = (F.col("age_lo") == 0) & F.col("age_hi").isin(3, 4)
    return rows.filter(~whole & F.col("study").isin("Brand#2", "Brand#17"))


@query("if_else", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS size,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS filled FROM orders""")
def if_else(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    size = F.when(F.col("o_totalprice") >= 300000, "large").when(F.col("o_totalprice") >= 100000, "medium").otherwise("small")
    return o.select("o_orderkey", size.alias("size"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("filled"))


# ---- set operations


@query("union_by_name", """
SELECT unit, period, pop, NULL::DOUBLE AS events FROM (SELECT unit, period, sum(pop) AS pop FROM v_pop GROUP BY 1, 2)
UNION ALL SELECT unit, period, NULL, events FROM v_event""")
def union_by_name(spark, sf):
    totals = V.pop(spark, sf).groupBy("unit", "period").agg(F.sum("pop").alias("pop"))
    return S.union_named(totals, V.event(spark, sf))


@query("union_with_source_id", " UNION ALL ".join(
    f"SELECT period, unit, events, {i} AS source FROM v_event WHERE period = {p}" for i, p in enumerate(PERIODS, 1)))
def union_with_source_id(spark, sf):
    ev = V.event(spark, sf)
    return S.union_named(*[ev.filter(F.col("period") == p) for p in PERIODS], source="source")


@query("union_distinct", """
SELECT l_suppkey AS suppkey, l_returnflag AS flag FROM lineitem WHERE l_discount >= 0.05
UNION SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_tax >= 0.04""")
def union_distinct(spark, sf):
    li = V.scan(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_discount", "l_tax")
    pair = [F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag")]
    return S.union_named(li.filter("l_discount >= 0.05").select(*pair), li.filter("l_tax >= 0.04").select(*pair)).distinct()


# ---- reshape


@query("pivot_wide", """
SELECT unit, period, sum(pop) FILTER (age = 0) AS age_0, sum(pop) FILTER (age = 1) AS age_1, sum(pop) FILTER (age = 2) AS age_2,
       sum(pop) FILTER (age = 3) AS age_3, sum(pop) FILTER (age = 4) AS age_4, sum(pop) FILTER (age = 5) AS age_5
FROM v_pop WHERE age <= 5 GROUP BY 1, 2""")
def pivot_wide(spark, sf):
    return S.to_wide(V.pop(spark, sf).filter("age <= 5"), ["unit", "period"], "age", "pop", list(range(6)), "age_")


@query("pivot_long", """
UNPIVOT (SELECT unit, wealth, discount, tax, lines FROM v_cov_x) ON wealth, discount, tax, lines INTO NAME name VALUE value""")
def pivot_long(spark, sf):
    return S.to_long(V.covariates(spark, sf), ["unit"], ["wealth", "discount", "tax", "lines"])


@query("pivot_long_paired", f"""
WITH w AS (SELECT unit, {', '.join(f'sum(pop) FILTER (period = {p}) AS p{p}' for p in PERIODS)} FROM v_pop GROUP BY 1),
e AS (SELECT unit, {', '.join(f'sum(events) FILTER (period = {p}) AS e{p}' for p in PERIODS)} FROM v_event GROUP BY 1)
{' UNION ALL '.join(f'SELECT unit, {p} AS period, p{p} AS pop, e{p} AS events FROM w JOIN e USING (unit)' for p in PERIODS)}""")
def pivot_long_paired(spark, sf):
    totals = V.pop(spark, sf).groupBy("unit", "period").agg(F.sum("pop").alias("pop"))
    pops = S.to_wide(totals, ["unit"], "period", "pop", PERIODS, "pop_")
    evs = S.to_wide(V.event(spark, sf), ["unit"], "period", "events", PERIODS, "events_")
    groups = {p: {"pop": f"pop_{p}", "events": f"events_{p}"} for p in PERIODS}
    return S.to_long_paired(pops.join(evs, "unit"), ["unit"], groups, "period")


WIDE_METRICS = f"""
w AS (SELECT unit, {', '.join(f'sum(pop) FILTER (period = {p}) AS p{p}' for p in PERIODS)} FROM v_pop GROUP BY 1)"""


@query("name_split_long", f"""
WITH {WIDE_METRICS}
{' UNION ALL '.join(f"SELECT unit, 'pop' AS metric, '{p}' AS year, 'ob' AS process, p{p} AS value FROM w" for p in PERIODS)}""")
def name_split_long(spark, sf):
    totals = V.pop(spark, sf).groupBy("unit", "period").agg(F.sum("pop").alias("pop"))
    wide = S.to_wide(totals, ["unit"], "period", "pop", PERIODS, "pop_").withColumnsRenamed({f"pop_{p}": f"pop_{p}_ob" for p in PERIODS})
    long = S.to_long(wide, ["unit"], [f"pop_{p}_ob" for p in PERIODS])
    return T.split_parts(long, "name", ["metric", "year", "process"])


_MONTHS = [(p, m) for p in PERIODS for m in range(1, 13)]


@query("name_unite_wide", f"""
SELECT unit, {', '.join(f'sum(events) FILTER (period = {p} AND mon = {m}) AS "{p}_{m}"' for p, m in _MONTHS)}
FROM v_event_month GROUP BY 1""")
def name_unite_wide(spark, sf):
    named = S.unite(V.event_month(spark, sf), "name", ["period", "mon"])
    return S.to_wide(named, ["unit"], "name", "events", [f"{p}_{m}" for p, m in _MONTHS])


@query("grid_complete", """
WITH k AS (SELECT DISTINCT unit, period FROM v_event_month)
SELECT k.unit, k.period, CAST(m.mon AS INTEGER) AS mon, e.events FROM k CROSS JOIN range(1, 13) m(mon)
LEFT JOIN v_event_month e ON e.unit = k.unit AND e.period = k.period AND e.mon = m.mon""")
def grid_complete(spark, sf):
    from panelweave.operators.impute import month_grid

    return month_grid(V.event_month(spark, sf), ["unit"], "period", "mon", "events")


# ---- sorting


@query("sort", "SELECT unit, period, events FROM v_event ORDER BY events DESC, unit, period")
def sort(spark, sf):
    return V.event(spark, sf).orderBy(F.desc("events"), "unit", "period")


@query("sort_in_group", """
SELECT unit, period, events, CAST(row_number() OVER (PARTITION BY unit ORDER BY period) AS INTEGER) AS step FROM v_event""")
def sort_in_group(spark, sf):
    step = F.row_number().over(W.partitionBy("unit").orderBy("period"))
    return V.event(spark, sf).withColumn("step", step)


@query("row_index", """
SELECT o_orderkey, o_orderpriority, row_number() OVER w AS position, count(*) OVER (PARTITION BY o_orderpriority) AS total
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""")
def row_index(spark, sf):
    """Row numbers in five large groups, without gathering a group in one task."""
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    out = row_positions(o, ["o_totalprice", "o_orderkey"], ["o_orderpriority"])
    return out.select("o_orderkey", "o_orderpriority", "position", "total")


@query("first_row", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1""")
def first_row(spark, sf):
    o = V.scan(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return K.first_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("category_order", """
SELECT o_orderpriority, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS INTEGER) AS sort_key
FROM orders GROUP BY 1""")
def category_order(spark, sf):
    return category_order_of(V.scan(spark, sf, "orders", "o_orderpriority"), "o_orderpriority")


# ---- scalar functions


@query("s_substr", """
SELECT unit, substr(unit, 1, 1) AS region, substr(unit, 1, 3) AS province, substr(unit, 2, 2) AS nation, substr(unit, 4, 1) AS cls
FROM v_unit""")
def s_substr(spark, sf):
    return V.units(spark, sf).select(
        "unit", *[T.code_segment("unit", a, b).alias(n) for n, a, b in
                  (("region", 1, 1), ("province", 1, 3), ("nation", 2, 3), ("cls", 4, 4))]
    )


@query("s_paste", "SELECT p_partkey, p_brand || ' ' || p_type AS a, concat_ws('_', p_brand, p_size, p_type) AS b FROM part")
def s_paste(spark, sf):
    return V.scan(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(" "), "p_type").alias("a"),
        F.concat_ws("_", "p_brand", F.col("p_size").cast("string"), "p_type").alias("b"),
    )


@query("s_gsub", r"""
SELECT c_custkey, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, regexp_replace(c_name || '省', '[\x01-\x7F]+', '', 'g') AS local_part,
       regexp_replace(c_mktsegment, 'A|E', '-', 'g') AS replaced FROM customer""")
def s_gsub(spark, sf):
    return V.scan(spark, sf, "customer").select(
        "c_custkey", T.strip_digits("c_name").alias("letters"),
        T.strip_ascii(F.concat("c_name", F.lit("省"))).alias("local_part"),
        F.regexp_replace("c_mktsegment", "A|E", "-").alias("replaced"),
    )


@query("s_remove", "SELECT p_partkey, replace(p_brand, '#', '') AS brand FROM part")
def s_remove(spark, sf):
    return V.scan(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "").alias("brand"))


@query("s_parse_number", r"""
SELECT event_id, TRY_CAST(regexp_extract(replace(props, ',', ''), '(-?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS k,
       TRY_CAST(nullif(regexp_extract(event_type, '(-?[0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS none FROM events""")
def s_parse_number(spark, sf):
    return V.scan(spark, sf, "events").select("event_id", T.parse_number("props").alias("k"), T.parse_number("event_type").alias("none"))


@query("s_separate", "SELECT s_suppkey, split_part(s_name, '#', 1) AS kind, split_part(s_name, '#', 2) AS number FROM supplier")
def s_separate(spark, sf):
    return T.split_parts(V.scan(spark, sf, "supplier", "s_suppkey", "s_name"), "s_name", ["kind", "number"])


@query("s_word", "SELECT p_partkey, split_part(p_name, ' ', 1) AS word FROM part")
def s_word(spark, sf):
    return V.scan(spark, sf, "part").select("p_partkey", T.first_word("p_name").alias("word"))


@query("s_grepl", """
SELECT p_partkey, regexp_matches(p_name, 'bolt|ring') AS hit, NOT regexp_matches(p_name, '^red') AS not_red FROM part""")
def s_grepl(spark, sf):
    name = F.col("p_name")
    return V.scan(spark, sf, "part").select("p_partkey", name.rlike("bolt|ring").alias("hit"), (~name.rlike("^red")).alias("not_red"))


@query("s_label", """
SELECT unit, CASE WHEN n_name = 'NATION_3' THEN 'Third' ELSE n_name END AS name,
       CASE substr(unit, 1, 1) WHEN '0' THEN 'Africa' WHEN '1' THEN 'America' WHEN '2' THEN 'Asia' WHEN '3' THEN 'Europe'
       WHEN '4' THEN 'Middle East' END AS region_label FROM v_unit""")
def s_label(spark, sf):
    labels = IO.literal_table(spark, REGION_LABELS, "region string, region_label string, sort_key int")
    u = T.unit_levels(V.units(spark, sf), "unit", {"region": 1}).join(labels, "region", "left")
    name = F.when(F.col("n_name") == "NATION_3", "Third").otherwise(F.col("n_name"))
    return u.select("unit", name.alias("name"), "region_label")


@query("m_arith", f"""
SELECT o_orderkey, {rd('abs(o_totalprice - 200000)')} AS distance, o_totalprice / nullif(o_custkey, 0) AS ratio
FROM orders""")
def m_arith(spark, sf):
    o = V.scan(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_custkey")
    return o.select(
        "o_orderkey", (F.round(F.abs(F.col("o_totalprice") - 200000), 6) + 0.0).alias("distance"),
        N.safe_ratio("o_totalprice", "o_custkey").alias("ratio"),
    )


@query("m_logexp", f"""
SELECT p_partkey, {rd('ln(p_retailprice)')} AS a, {rd('exp(p_size / 10.0)')} AS b, {rd('sqrt(p_size)')} AS c,
       {rd('log10(p_retailprice)')} AS d FROM part""")
def m_logexp(spark, sf):
    return rounded(V.scan(spark, sf, "part").select(
        "p_partkey", F.ln("p_retailprice").alias("a"), F.exp(F.col("p_size") / 10.0).alias("b"),
        F.sqrt("p_size").alias("c"), F.log10("p_retailprice").alias("d"),
    ))


@query("c_cast", """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS code, TRY_CAST(substr(c_name, 10) AS INTEGER) AS number,
       TRY_CAST(c_mktsegment AS DOUBLE) AS none FROM customer""")
def c_cast(spark, sf):
    return V.scan(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("code"),
        F.expr("substring(c_name, 10)").try_cast("int").alias("number"), F.col("c_mktsegment").try_cast("double").alias("none"),
    )
