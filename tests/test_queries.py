"""Every registered query against its oracle on the smallest tables, and plan rules."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        # the smallest tables may leave a filtered report empty; everything else must agree
        assert [p for p in compare(df, con, ORACLES[name]) if p != "no rows"] == []
    else:
        assert df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cohort_coverage", "eligible_population", "scenario_grid", "availability_coverage", "unique_fuzzy_match"])
def test_no_cartesian_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def _staged(spark, sf, monkeypatch, name):
    """(label, plan) of what a repair writes, in order, and last of its result."""
    from panelweave.plans import events
    from panelweave.session import stage
    from workload import joins

    plans = []

    def record(df, label="stage"):
        plans.append((label, plan(df)))
        return stage(df, label)

    monkeypatch.setattr(events, "stage", record)
    monkeypatch.setattr(joins, "stage", record)
    plans.append(("result", plan(QUERIES[name](spark, sf))))
    return plans


@pytest.mark.parametrize("name", ["code_repair_conflicts", "code_repair", "code_repair_located", "code_repair_audit"])
def test_evidence_sorts_no_pieces(spark, sf, monkeypatch, name):
    """What a repair writes counts the pieces of names in hash tables."""
    from panelweave.plans import events
    from panelweave.session import stage
    from workload import joins

    plans = []

    def record(df, label="stage"):
        plans.append(plan(df))
        return stage(df, label)

    monkeypatch.setattr(events, "stage", record)
    monkeypatch.setattr(joins, "stage", record)
    QUERIES[name](spark, sf)
    counted = [p for p in plans if "_piece" in p]
    assert counted
    assert not [p for p in counted if re.search(r"SortAggregate\(key=\[[^\]]*_piece", p)]


@pytest.mark.parametrize("name", ["code_repair_conflicts", "code_repair_audit"])
def test_evidence_matches_once(spark, sf, monkeypatch, name):
    """The search for codes without a name doesn't match all names again, and what finds the lost codes doesn't match."""
    plans = _staged(spark, sf, monkeypatch, name)
    assert [len(re.findall(r"Generate explode\(.*\[_piece", p)) for _, p in plans if "_piece" in p] == [1]
    assert not [p for _, p in plans if "_piece" in p and "lineitem" in p]


@pytest.mark.parametrize("name", ["code_repair_conflicts", "code_repair", "code_repair_located", "code_repair_audit"])
def test_lost_codes_broadcast_nothing(spark, sf, monkeypatch, name):
    """The known codes are not held whole by every task that looks for the lost ones."""
    lost = [p for label, p in _staged(spark, sf, monkeypatch, name) if label == "lost"]
    assert len(lost) == 1
    assert "Broadcast" not in lost[0]


@pytest.mark.parametrize("name", ["code_repair", "code_repair_located"])
def test_repair_sums_facts_once(spark, sf, monkeypatch, name):
    """Lines are summed once per code and period, and once more after recoding: one hash table of them in a task."""
    plans = _staged(spark, sf, monkeypatch, name)
    summed = [p for label, p in plans if label == "facts"]
    assert [p.count("partial_sum(") for p in summed] == [1]
    # the result's own scan of the facts goes into one sum, the located share adds one per code and one in all
    assert plans[-1][1].count("partial_sum(events") == {"code_repair": 1, "code_repair_located": 2}[name]


@pytest.mark.parametrize("name", ["code_repair", "code_repair_located"])
def test_repair_adds_up_only_what_meets(spark, sf, monkeypatch, name):
    """After recoding, sums per code and period hold the mapping's codes only, and the share joins no list of all codes."""
    text = _staged(spark, sf, monkeypatch, name)[-1][1]
    sums = re.findall(r"partial_sum\(events[^\n]*output=\[code#\d+, period(?s:.*?)FileScan", text)
    assert len(sums) == 1 and "LeftSemi" in sums[0]
    assert "LeftOuter" not in text.replace(sums[0], "")


def test_coverage_shuffles_cells_once(spark, sf):
    """One exchange combines the inputs, one places the cells; windows and coverage sums add none."""
    from panelweave.plans.coverage import cohort_coverage
    from workload import views as V
    from workload.registry import FACTOR, PERIODS

    pop = spark.createDataFrame([], "unit string, age int, period int, pop double").repartition(3)
    ev = spark.createDataFrame([], "unit string, period int, events double").repartition(3)
    text = plan(cohort_coverage(ev, pop, FACTOR, PERIODS))
    assert text.count("hashpartitioning(") == 2
    assert text.index("hashpartitioning(unit") > text.rindex("Generate explode")
    assert "partial_sum" in text
    lines = plan(V.event(spark, sf))
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_discount), EqualTo(l_returnflag,R)" in lines
