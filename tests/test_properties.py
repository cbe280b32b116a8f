"""Random panels against plain Python, with repeats, gaps and NULLs."""

import random
from collections import defaultdict

import pytest

from panelweave.operators import keys as K
from panelweave.plans import coverage as C, population as P

FACTOR = {0: 0.5, 1: 1.0, 2: 1.0}
PERIODS = [1, 2, 3, 4]


def panel(seed):
    rng = random.Random(seed)
    pop, events = [], []
    for u in ("a1", "a2", "b1", "b2", "hot"):
        for y in PERIODS:
            for a in range(4):
                if rng.random() < 0.06:
                    continue
                value = None if rng.random() < 0.03 else float(rng.randint(1, 50))
                pop.append((u, a, y, value))
            if rng.random() < 0.85:
                events.append((u, y, float(rng.randint(0, 30))))
    pop += [("hot", rng.randint(0, 3), rng.choice(PERIODS), 1.0) for _ in range(300)]
    return pop, events


def brute(pop, events):
    """coverage by (unit, period), one row at a time."""
    cell, null = defaultdict(float), set()
    for u, a, y, v in pop:
        if v is None:
            null.add((u, y, a))
        else:
            cell[u, y, a] += v
    out, cum = {}, defaultdict(float)
    doses = dict(((u, y), v) for u, y, v in events)
    for y in PERIODS:
        for u in {r[0] for r in pop}:
            ages = [(u, y, a) for a in FACTOR]
            if (u, y) not in doses or any(k in null or k not in cell for k in ages):
                continue
            eligible = sum(FACTOR[a] * cell[u, y, a] for a in FACTOR)
            for a in FACTOR:
                cum[u, y - a] += doses[u, y] * FACTOR[a] * cell[u, y, a] / eligible
            out[u, y] = sum(cum[u, y - a] for a in FACTOR) / eligible
    return out


@pytest.mark.parametrize("seed", range(4))
def test_coverage(spark, seed):
    pop, events = panel(seed)
    p = spark.createDataFrame(pop, "unit string, age int, period int, pop double")
    e = spark.createDataFrame(events, "unit string, period int, events double")
    cov = C.cohort_coverage(e, p, FACTOR, PERIODS)
    units = C.level_extremes(C.unit_coverage(cov), {"region": 1})
    want = brute(pop, events)
    got = {(r.unit, r.period): r for r in units.collect()}
    assert {k: r.coverage for k, r in got.items()} == pytest.approx(want)
    for (u, y), r in got.items():
        same = [v for (k, t), v in want.items() if k[0] == u[0] and t == y]
        assert (r.region_max, r.region_min) == (pytest.approx(max(same)), pytest.approx(min(same)))
    total = sum(v for u, y, v in events if (u, y) in want)
    assert sum(r.doses for r in cov.collect()) == pytest.approx(total)


@pytest.mark.parametrize("seed", range(3))
def test_eligible_population(spark, seed):
    pop, _ = panel(seed)
    p = spark.createDataFrame(pop, "unit string, age int, period int, pop double")
    got = {(r.unit, r.period): r.eligible for r in P.unit_eligibility(p, FACTOR, "unit", "age", "period", "pop").collect()}
    for (u, y), value in got.items():
        rows = [(a, v) for k, a, t, v in pop if (k, t) == (u, y) and a in FACTOR]
        whole = {a for a, _ in rows} == set(FACTOR) and all(v is not None for _, v in rows)
        want = sum(FACTOR[a] * v for a, v in rows) if whole else None
        assert value == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_match(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
    block = lambda: "hot" if rng.random() < 0.5 else rng.choice("xyz")
    dim = [(f"d{i}", word(), block()) for i in range(25)]
    src = [(f"s{i}", word(), block()) for i in range(60)]
    schema = "code string, name string, block string"
    got = {r["from"]: r["to"] for r in K.unique_fuzzy_match(spark.createDataFrame(src, schema), spark.createDataFrame(dim, schema)).collect()}
    want = {}
    for c, n, b in src:
        hits = [d for d, m, k in dim if k == b and n[:2] in m]
        if len(hits) == 1:
            want[c] = hits[0]
    assert got == want
