"""Hand-computed fixtures: coverage, weights, gap filling, growth rule, bounds, trends, codes, statistics."""

import math

import pytest
from pyspark.sql import functions as F

from panelweave.functions import nulls as N
from panelweave.functions.text import parse_number, split_parts, strip_ascii
from panelweave.operators import keys as K, models as M, ranks as Q, shape as S
from panelweave.operators.impute import annualise, impute_monthly
from panelweave.plans import coverage as C, events as E, population as P, reports as R, scenarios as SC

FACTOR = {0: 0.5, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def panel(spark):
    data = [("u1", a, 2016, 100.0) for a in range(6)] + [("u1", a, 2017, 90.0 if a == 1 else 100.0) for a in range(6)]
    return spark.createDataFrame(data, "unit string, age int, period int, pop double")


@pytest.fixture(scope="module")
def doses(spark):
    return spark.createDataFrame([("u1", 2016, 55.0), ("u1", 2017, 110.0)], "unit string, period int, events double")


def test_cohort_coverage(panel, doses):
    cov = C.cohort_coverage(doses, panel, FACTOR, [2016, 2017])
    got = {(r.period, r.age): r for r in cov.collect()}
    assert len(got) == 12
    assert [got[2016, a].doses_cum for a in range(6)] == pytest.approx([5, 10, 10, 10, 10, 10])
    assert [got[2017, a].doses_cum for a in range(6)] == pytest.approx([10.185185, 23.333333] + [30.370370] * 4, abs=1e-6)
    assert [got[2017, a].ratio for a in range(6)] == pytest.approx([1, 0.9, 1, 1, 1, 1])
    assert [got[2017, a].age_coverage for a in range(6)] == pytest.approx([0.101852, 0.233333] + [0.303704] * 4, abs=1e-6)
    assert got[2016, 0].coverage == pytest.approx(0.1)
    assert got[2017, 0].covered == pytest.approx(155)
    assert got[2017, 0].coverage == pytest.approx(0.287037, abs=1e-6)


def test_missing_age_removes_the_unit_period(panel, doses):
    cov = C.cohort_coverage(doses, panel.filter("NOT (period = 2017 AND age = 3)"), FACTOR, [2016, 2017])
    assert {r.period for r in cov.select("period").distinct().collect()} == {2016}
    elig = P.eligible_population(panel.filter("NOT (period = 2017 AND age = 3)"), FACTOR)
    assert rows(elig.select("period", "eligible")) == [(2016, 550.0)]


def test_null_population_and_extra_ages(spark):
    data = [("a", k, 1, 10.0) for k in range(7)] + [("b", k, 1, None if k == 2 else 10.0) for k in range(7)]
    pop = spark.createDataFrame(data, "unit string, age int, period int, pop double")
    assert rows(P.eligible_population(pop, FACTOR).select("unit", "tot", "eligible")) == [("a", 70.0, 55.0)]
    risk = {r.unit: (r.tot, r.at_risk) for r in P.risk_population(pop, 5).collect()}
    assert risk == {"a": (70.0, 60.0), "b": (None, None)}


def test_survey_weights(spark, panel):
    survey = [("s", "u1", 2016, a, n, 420.0) for a, n in enumerate([64.5, 129.0, 78.0, 33.0, 33.0, 33.0])]
    survey = spark.createDataFrame(survey, "scenario string, ref_unit string, ref_period int, age int, num double, den double")
    w = [r.weight for r in C.alloc_weights_survey(panel, survey).orderBy("age").collect()]
    assert w == pytest.approx([0.174089, 0.348178, 0.210526, 0.089069, 0.089069, 0.089069], abs=1e-6)
    assert sum(w) == pytest.approx(1)


def test_allocation_invariants(spark, panel, doses):
    weights = spark.createDataFrame([("s", a, 1 / 6) for a in range(6)], "scenario string, age int, weight double")
    cov = C.cohort_coverage(doses, panel, FACTOR, [2016, 2017], weights)
    for r in cov.groupBy("scenario", "period").agg(F.sum("doses").alias("d"), F.sum("weight").alias("w")).collect():
        assert r.w == pytest.approx(1)
        assert r.d == pytest.approx({2016: 55.0, 2017: 110.0}[r.period])


def test_linear_gap_filling(spark):
    seen = [("u", 2019, m, v) for m, v in [(2, 10.0), (4, 20.0), (5, 30.0), (9, 50.0)]]
    few = [("v", 2019, m, 5.0) for m in (1, 2, 3)]
    df = spark.createDataFrame(seen + few, "unit string, period int, mon int, events double")
    annual, monthly = impute_monthly(df, ["unit"], "period", "mon", "events")
    assert [r.filled for r in monthly.orderBy("mon").collect()] == pytest.approx([10, 10, 15, 20, 30, 35, 40, 45, 50, 50, 50, 50])
    assert rows(annual) == [("u", 2019, 405.0)]


def test_spline_gap_filling(spark):
    cubic = {m: float(m**3 - 4 * m**2 + m) for m in range(1, 13)}
    df = spark.createDataFrame(
        [("u", 2019, m, v) for m, v in cubic.items() if m not in (3, 7, 8)], "unit string, period int, mon int, events double"
    )
    monthly = impute_monthly(df, ["unit"], "period", "mon", "events", method="spline")[1]
    assert [r.filled for r in monthly.orderBy("mon").collect()] == pytest.approx(list(cubic.values()), abs=1e-7)


def test_spline_brute_force(spark):
    """Natural spline against the minimiser of integrated squared curvature on a fine grid of knots."""
    import numpy as np

    from panelweave.operators.impute import spline_values

    t, x = np.array([1.0, 3.0, 4.0, 8.0]), np.array([2.0, 5.0, 1.0, 4.0])
    n = len(t) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        for at in (t[i], t[i + 1]):
            a[row, 4 * i : 4 * i + 4] = [at**k for k in range(4)]
            b[row] = x[i] if at == t[i] else x[i + 1]
            row += 1
    for i in range(n - 1):
        p = t[i + 1]
        for d in ([0, 1, 2 * p, 3 * p**2], [0, 0, 2, 6 * p]):
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8] = d, [-v for v in d]
            row += 1
    a[row, :4], a[row + 1, -4:] = [0, 0, 2, 6 * t[0]], [0, 0, 2, 6 * t[-1]]
    coef = np.linalg.solve(a, b).reshape(n, 4)
    at = np.array([1.5, 2.0, 3.3, 5.0, 7.9])
    piece = np.searchsorted(t, at, side="right") - 1
    assert spline_values(t, x, at, "natural") == pytest.approx([sum(coef[i][k] * v**k for k in range(4)) for i, v in zip(piece, at)])


def test_annualise(spark):
    df = spark.createDataFrame([("u", m, 10.0) for m in range(1, 10)], "unit string, mon int, events double")
    assert rows(annualise(df, ["unit"], "mon", "events")) == [("u", 120.0, 9)]


def test_growth_rule(spark):
    series = {"up": [100, 120, 160], "edge": [100, 80, 100], "zero": [0, 50, 50], "gap": [100, None, 500]}
    df = spark.createDataFrame(
        [(u, 2016 + i, None if v is None else float(v)) for u, vs in series.items() for i, v in enumerate(vs)],
        "unit string, period int, pop double",
    )
    kept, flagged = P.growth_qa(df)
    assert {r.unit for r in kept.select("unit").distinct().collect()} == {"edge", "gap"}
    assert {(r.unit, r.reason) for r in flagged.collect()} == {("up", "rise"), ("zero", "from_zero")}


def test_bounds(spark):
    ev = spark.createDataFrame([("u", 2016, 100.0), ("u", 2017, 150.0), ("u", 2018, 200.0)], "unit string, period int, events double")
    sh = spark.createDataFrame([("S", "u", 2016, 0.2), ("S", "u", 2017, 0.1), ("S", "u", 2018, 0.5)], "source string, unit string, period int, share double")
    got = {(r.period, r.bound): r.value for r in SC.ageing_out_bounds(ev, sh).collect()}
    assert [got[y, b] for y in (2016, 2017, 2018) for b in ("LL", "UL")] == pytest.approx([80, 100, 200, 230, 405, 425])


def test_trend_shape(spark):
    data = [("a", [20.0, 30.0, 50.0]), ("b", [50.0, 45.0, 5.0]), ("c", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(u, 2016 + i, v) for u, vs in data for i, v in enumerate(vs)], "unit string, period int, events double")
    got = {r.unit: (round(r.k, 6), r.type) for r in SC.trend_shape(df, [2016, 2017, 2018]).collect()}
    assert got == {"a": (0.33, "increasing or stabilising"), "b": (0.57, "other")}


def test_recode_pairs(spark):
    pairs = spark.createDataFrame([(1, "A", "B"), (2, "C", "D"), (3, "E", "F"), (4, "A", "D")], "row int, ver1 string, ver2 string")
    known = spark.createDataFrame([("A",), ("D",)], "code string")
    mapping = K.recode_pairs(pairs, known)
    assert rows(mapping, "from") == [("B", "A"), ("C", "D")]
    facts = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 4.0), (None, 1, 8.0)], "code string, y int, v double")
    moved = K.recode_apply(facts, "code", mapping, ["code", "y"], "v")
    assert sorted(rows(moved), key=str) == sorted([("A", 1, 3.0), ("D", 1, 4.0), (None, 1, 8.0)], key=str)


def test_unique_fuzzy_match(spark):
    dim = spark.createDataFrame(
        [("t1", "xLong", "1"), ("t2", "Mono", "1"), ("t3", "Molo", "1"), ("t4", "Zulu", "2"), ("t5", "Kilo", "1"), ("t6", None, "1"),
         ("t7", "aa aab", "1"), ("t8", "Q", "3")],
        "code string, name string, block string",
    )
    lost = spark.createDataFrame(
        [("s1", "Longtown", "1"), ("s2", "Motown", "1"), ("s3", "Zulu", "1"), ("s4", "Kiev", "1"), ("s5", None, "1"), ("s6", "aa", "1"),
         ("s7", "Q", "3"), ("s8", "", "2"), ("s9", "", "1")],
        "code string, name string, block string",
    )
    black = spark.createDataFrame([("t5",)], "code string")
    assert rows(K.unique_fuzzy_match(lost, dim, blacklist=black), "from") == [("s1", "t1"), ("s6", "t7"), ("s7", "t8"), ("s8", "t4")]


def test_candidate_pieces_are_counted_without_a_sort(spark):
    """A name has dozens of pieces, so what is kept per piece must be a hash table entry, not a row to sort."""
    dim = spark.createDataFrame(
        [("t10", "Mono", "1"), ("t9", "Molo", "1"), (None, "Moro", "1"), (None, "Qa", "1"), ("t2", "Mo", "2"), ("t3", None, "2"), ("t4", "Mo", None)],
        "code string, name string, block string",
    )
    lost = spark.createDataFrame(
        [("s1", "Mole", "1"), ("s2", "Qat", "1"), ("s3", "Mo", "2"), ("s4", "lot", "1"), ("s5", "Mo", None), ("s6", None, "1"), ("s7", "x", "1")],
        "code string, name string, block string",
    )
    found = K.count_candidates(lost, dim)
    assert rows(found.select("code", "n_candidates", "to"), "code") == [
        ("s1", 3, "t10"), ("s2", 1, None), ("s3", 1, "t2"), ("s4", 1, "t9"), ("s5", 0, None), ("s6", 0, None), ("s7", 0, None)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_code_repair_null_safe_override(spark):
    """An absent place must not wipe the block found otherwise."""
    dim = spark.createDataFrame([("k1", "Alpha", "45"), ("k2", "Beta", "62")], "code string, name string, block string")
    facts = spark.createDataFrame([("k1", 1, 5.0), ("x", 1, 7.0), ("y", 1, 1.0)], "code string, period int, events double")
    names = spark.createDataFrame([("x", 1, "Alx", "p", None)], "code string, row int, name string, place string, area string")
    second = spark.createDataFrame([("y", 1, "Bex", "far")], "code string, row int, name string, area string")
    places = spark.createDataFrame([("p", "45")], "place string, block string")
    over = spark.createDataFrame([("area", "far", "62"), ("place", "zzz", "11")], "field string, match string, block string")
    none = spark.createDataFrame([], "code string")
    fixed, audit, located = E.code_repair(facts, dim, [names, second], places, over, none)
    assert rows(fixed, "code") == [("k1", 1, 12.0), ("k2", 1, 1.0)]
    assert rows(audit, "from") == [("x", "k1", "name"), ("y", "k2", "name")]
    assert located.first().unlocated_share == 0


def test_strict_and_lenient_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    got = df.groupBy("k").agg(N.strict_sum("v").alias("s"), F.sum("v").alias("l"), N.zero_sum("v").alias("z"))
    assert rows(got, "k") == [("a", None, 3.0, 3.0), ("b", None, None, 0.0)]


def test_reconcile(spark):
    frames = [spark.createDataFrame([("u", 1, v)], "unit string, period int, events double") for v in (10.0, 10.0, 16.0)]
    assert rows(E.event_reconcile(*frames)) == [("u", 1, 13.0, 2)]


def test_duplicate_key_rule(spark):
    df = spark.createDataFrame(
        [("64a", 1, 1.0), ("64a", 1, 2.0), ("11a", 1, 1.0), ("11a", 1, 1.0), ("11a", 2, 5.0), ("11b", 1, 4.0)], "unit string, y int, v double"
    )
    out = K.drop_duplicated_units(df, "unit", ["unit", "y"], "v", F.substring("unit", 1, 2) == "64")
    assert rows(out, "unit") == [("11b", 1, 4.0), ("64a", 1, 3.0)]


def test_membership_with_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(K.members(df, keys, ["k"])) == [("a",)]
    assert sorted(rows(K.non_members(df, keys, ["k"])), key=str) == sorted([("b",), (None,)], key=str)


def test_harmonise_does_not_count_renamed_codes_twice(spark):
    a = spark.createDataFrame([("110001", "old name", 0, 2016, 10.0), ("110002", "x", 0, 2016, 1.0)], "unit string, name string, age int, period int, pop double")
    b = spark.createDataFrame([("110001", 0, 2017, 20.0), ("119999", 0, 2017, 2.0), ("120001", 0, 2017, 9.0)], "unit string, age int, period int, pop double")
    pairs = spark.createDataFrame([(1, "119999", "110002")], "row int, ver1 string, ver2 string")
    known = spark.createDataFrame([("110001",), ("110002",)], "code string")
    white = spark.createDataFrame([("11",)], "province string")
    out = P.pop_harmonise([a, b], [2016, 2017], white, pairs, known)
    assert rows(out.select("unit", "province", "period", "pop"), "unit", "period") == [
        ("110001", "11", 2016, 10.0), ("110001", "11", 2017, 20.0), ("110002", "11", 2016, 1.0), ("110002", "11", 2017, 2.0)
    ]


def test_extrapolation(spark):
    df = spark.createDataFrame([("u", 2016, 1000.0), ("u", 2017, 1100.0), ("v", 2016, 7.0)], "unit string, period int, value double")
    assert rows(SC.extrapolate_linear(df, 2018), "unit") == [("u", 2018, 1200.0, 1100.0), ("v", 2018, 7.0, 7.0)]


def test_scenario_grid_drops_whole_units(spark):
    bounds = spark.createDataFrame([("S", u, y, "LL", v) for u, y, v in [("a", 1, 5.0), ("a", 2, 15.0), ("b", 1, 5.0)]], "source string, unit string, period int, bound string, value double")
    pops = spark.createDataFrame([("YB", "ob", u, y, 10.0) for u in "ab" for y in (1, 2)], "pop_source string, process string, unit string, period int, pop double")
    assert [r.unit for r in SC.scenario_grid(bounds, pops).collect()] == ["b"]


def test_statistics(spark):
    two = spark.createDataFrame([(True, v) for v in (1.0, 2.0, 3.0)] + [(False, v) for v in (2.0, 4.0, 6.0)], "flag boolean, x double")
    assert M.cohens_d(two, ["x"], "flag").first().d == pytest.approx(-1.264911, abs=1e-6)
    ecdf = Q.ecdf_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "x double"), "x", "r")
    assert [r.r for r in ecdf.orderBy("x").collect()] == [0.25, 0.75, 0.75, 1.0]
    d = Q.distribution(spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.4, 1.0)], "x double"), "x").first()
    assert (d.q1, d.median, d.q3, d["mean"]) == pytest.approx((0.1, 0.2, 0.4, 0.34))
    assert d.sd == pytest.approx(0.397492, abs=1e-6)
    tiles = Q.ntile_rank(spark.createDataFrame([(v,) for v in range(5)], "x int"), ["x"], 4, "t")
    assert [r.t for r in tiles.orderBy("x").collect()] == [1, 1, 2, 3, 4]
    cells = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 40)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    chi = M.chisq_test(df, "a", "b").first()
    assert (chi.statistic, chi.df) == (pytest.approx(0.793651, abs=1e-6), 1)
    assert chi.p_value == pytest.approx(math.erfc(math.sqrt(0.793651 / 2)), abs=1e-6)


def test_burden_needs_every_year(spark):
    cases = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 8.0), ("b", 1, 1.0), ("c", 1, 2.0), ("c", 2, 2.0), ("d", 1, 2.0), ("d", 2, None)], "unit string, year int, cases double")
    pop = spark.createDataFrame([(u, 2.0) for u in "abcd"], "unit string, pop double")
    got = {r.unit: (r.burden, r.burden_s) for r in R.burden_rate(cases, pop, [1, 2]).collect()}
    assert got == {"a": (3.0, pytest.approx(math.sqrt(0.5))), "c": (1.0, pytest.approx(-math.sqrt(0.5)))}


def test_extreme_units(spark):
    df = spark.createDataFrame([(i, float(i), float(11 - i)) for i in range(1, 11)], "u int, h double, l double")
    assert [(r.u, r.severity) for r in R.extreme_units(df, "h", "l").orderBy("u").collect()] == [(9, "outer"), (10, "inner")]


def test_text_helpers(spark):
    df = spark.createDataFrame([("10-14", "ab北c京", "a_b-c"), ("1,234.5 x", "西", "a"), ("none", "", "")], "n string, m string, s string")
    got = df.select(parse_number("n").alias("n"), strip_ascii("m").alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(10.0, "北京"), (1234.5, "西"), (None, "")]
    parts = split_parts(df.select("s"), "s", ["p", None, "q"]).collect()
    assert [(r.p, r.q) for r in parts] == [("a", "c"), ("a", None), ("", None)]


def test_union_and_grid(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert rows(S.union_named(a, b, source="src", labels=["A", "B"]), "x") == [(1, 2, "A"), (3, None, "B")]
    assert S.grid(b, p=[1, 2], q=["u", "v"]).count() == 4


def test_splines_of_many_units_together(spark):
    """The batched sweep against one dense solve per unit, for 1 to 40 points, both kinds of ends, inside and outside."""
    import numpy as np

    from panelweave.operators.impute import spline_batch

    rng = np.random.default_rng(5)
    curves = [(np.sort(rng.choice(200, n, replace=False)).astype(float), rng.normal(size=n)) for n in (1, 2, 3, 4, 5, 17, 40, 2, 1, 6)]
    places = [np.concatenate([t, rng.uniform(t[0] - 5, t[-1] + 5, 9)]) for t, _ in curves]
    pick = lambda k: np.concatenate([c[k] for c in curves])
    row = np.repeat(np.arange(len(curves)), [len(t) for t, _ in curves])
    at_row = np.repeat(np.arange(len(curves)), [len(p) for p in places])
    for ends in ("cubic", "natural"):
        got = spline_batch(row, pick(0), pick(1), at_row, np.concatenate(places), len(curves), ends)
        for i, ((t, x), at) in enumerate(zip(curves, places)):
            n = len(t)
            if n == 1:
                assert got[at_row == i] == pytest.approx(np.full(len(at), x[0]))
                continue
            h, d = np.diff(t), np.diff(x) / np.diff(t)
            a, b = np.eye(n), np.zeros(n)
            for j in range(1, n - 1):
                a[j, j - 1 : j + 2], b[j] = (h[j - 1], 2 * (h[j - 1] + h[j]), h[j]), 6 * (d[j] - d[j - 1])
            if ends == "cubic" and n > 2:
                a[0, :2], a[-1, -2:] = (-1, 1), (-1, 1)
                if n > 3:
                    fit = [np.polyfit(t[k] - t[k][0], x[k], 3)[0] * 6 for k in (slice(0, 4), slice(n - 4, n))]
                    b[0], b[-1] = h[0] * fit[0], h[-1] * fit[1]
            m = np.linalg.solve(a, b)
            k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
            u, v = at - t[k], t[k + 1] - at
            want = (m[k] * v**3 + m[k + 1] * u**3) / (6 * h[k]) + (x[k] / h[k] - m[k] * h[k] / 6) * v + (x[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u
            assert got[at_row == i] == pytest.approx(want, rel=1e-6, abs=1e-6), (ends, n)


def test_growth_in_moving_windows(spark):
    """Every window agrees with the growth of that window alone; gaps in one unit close the window for its level and cohort."""
    import random

    from panelweave.plans.population import cohort_growth, cohort_growth_windows

    rng = random.Random(2)
    rows = [
        (u, u[0], a, p, float(rng.randint(0, 9)) if rng.random() < 0.03 else float(rng.randint(10, 99)))
        for u in ("a1", "a2", "b1", "b2", "b3") for p in range(2000, 2008) for a in range(7) if rng.random() > 0.04
    ]
    df = spark.createDataFrame(rows, "unit string, level string, age int, period int, pop double")
    periods = list(range(2000, 2008))
    for width in (2, 3, 5):
        got = cohort_growth_windows(df, periods, width, 5, "level").collect()
        want = [(s, r) for s in periods[: len(periods) - width + 1] for r in cohort_growth(df, list(range(s, s + width)), 5, "level").collect()]
        key = lambda w, r: (w, r.unit, r.level, r.cohort, r.period, r.rel_change, r.level_ratio)
        assert len(got) > 20 or width == 5
        exact = lambda rows: sorted((*k[:5], round(k[5], 9), round(k[6], 9)) for k in rows)
        assert exact(key(r.window, r) for r in got) == exact(key(w, r) for w, r in want)


@pytest.mark.parametrize("name", ["regression_frame", "corr_matrix", "extreme_units", "burden_rate", "corr_matrix_raw"])
def test_the_lines_are_read_once(spark, sf, monkeypatch, name):
    from workload import load, views as V

    scans, real = [], V.scan
    monkeypatch.setattr(V, "scan", lambda s, f, table, *c: (scans.append(table), real(s, f, table, *c))[1])
    out = load()[0][name](spark, sf)
    assert scans.count("lineitem") == 1
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString()


def test_repair_evidence_is_ranked_and_conflicts_stay(spark):
    """Each outcome once; an override outranks the place, a first source the second, and what loses against it is listed."""
    dim = spark.createDataFrame(
        [("k1", "Alpha", "1"), ("k2", "Alto", "2"), ("k3", "Beta", "1"), ("k4", "Bell", "1"), ("k5", "Gam", "3"), ("k6", "Alm", "4")], "code string, name string, block string")
    lost = spark.createDataFrame([(c,) for c in "abcdefg"], "code string")
    one = spark.createDataFrame(
        [("a", 2, "Alx", "moved"), ("a", 1, "Alz", "moved"), ("b", 1, "Bee", "p1"), ("c", 1, "Gax", "p3"), ("d", 1, None, "p1"), ("e", 1, "Zed", "p1"), ("f", 1, "Alf", "nowhere")],
        "code string, row int, name string, place string")
    two = spark.createDataFrame([("f", 1, "Al2", "p1", "far"), ("a", 1, "Al3", "p1", None)], "code string, row int, name string, place string, area string")
    places = spark.createDataFrame([("moved", "1"), ("p1", "1"), ("p1", "9"), ("p3", "3")], "place string, block string")
    over = spark.createDataFrame([("place", "moved", "2"), ("area", "far", "4"), ("area", "far", None)], "field string, match string, block string")
    black = spark.createDataFrame([("k5",)], "code string")
    audit, conflicts = E.judge_evidence(E.repair_evidence(lost, dim, [one, two], places, over, black))
    got = {r["from"]: (r.to, r.rule, r.source, r.block_by, r.outcome) for r in audit.collect()}
    assert got == {
        "a": ("k2", "name", 1, "place override", "match"), "b": (None, "unresolved", 1, "place", "several candidates"),
        "c": (None, "unresolved", 1, "place", "blacklisted"), "d": (None, "unresolved", 1, "place", "no name"),
        "e": (None, "unresolved", 1, "place", "no candidate"), "f": (None, "unresolved", 1, None, "no block"), "g": (None, "unresolved", None, None, "no name")}
    assert sorted(rows(conflicts), key=str) == sorted(
        [("a", "k2", "k1", 1, "place", "1"), ("a", "k2", "k1", 2, "place", "1"), ("f", None, "k6", 2, "area override", "4"), ("f", None, "k1", 2, "place", "1")], key=str)
