"""Small cases in which keys are NULL, repeated or look alike when joined."""

from pyspark.sql import functions as F


def test_group_share_keeps_null_groups(spark):
    from panelweave.operators.cohorts import group_share

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, v double")
    assert sorted((r.g or "", r.s) for r in group_share(df, ["g"], "v", "s").collect()) == [("", 1.0), ("a", 0.25), ("a", 0.75)]


def test_histogram_keys_do_not_run_together(spark):
    from panelweave.operators.describe import histogram

    df = spark.createDataFrame([("a|b", "c", 0.0), ("a", "b|c", 1.0), (None, "", 1.0), ("", None, 0.0)], "x string, y string, v double")
    out = histogram(df, "v", ["x", "y"], 3)
    assert out.count() == 12 and out.agg(F.sum("n")).first()[0] == 4


def test_recoding_keeps_the_total(spark):
    from panelweave.operators.keys import recode_column

    facts = spark.createDataFrame([("a", 1), ("b", 2)], "code string, v int")
    twice = spark.createDataFrame([("a", "z"), ("a", "y")], "from string, to string")
    assert sorted((r.code, r.v) for r in recode_column(facts, "code", twice).collect()) == [("b", 2), ("y", 1)]


def test_unmatched_keys_with_repeats_and_nulls(spark):
    from panelweave.operators.keys import unmatched_keys

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 1), ("c", 1)], "code string, n int")
    dim = spark.createDataFrame([("b",), ("b",), (None,), ("z",)], "code string")
    assert sorted(r.code for r in unmatched_keys(df, dim, "code").collect()) == ["a", "c"]
    assert sorted(r.code for r in unmatched_keys(df, dim.limit(0), "code").collect()) == ["a", "b", "c"]
    assert unmatched_keys(df.limit(0), dim, "code").collect() == []


def test_recoded_sums_meet_whatever_the_mapping(spark):
    """Chains, several targets, targets without rows and NULLs give the rows that summing everything gives."""
    from panelweave.operators.keys import recode_column, recode_sums

    facts = spark.createDataFrame(
        [("a", 1, 1.0), ("b", 1, 2.0), ("b", 2, None), ("c", 1, 4.0), ("d", None, 8.0), ("e", 1, 16.0), (None, 1, 32.0), ("f", 2, None)],
        "code string, period int, v double")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "z"), ("d", "y"), ("f", "b"), ("q", "e"), (None, "e")], "from string, to string")
    for m in (mapping, mapping.limit(0)):
        whole = recode_column(facts, "code", m).groupBy("code", "period").agg(F.sum("v").alias("v"))
        got = recode_sums(facts, "code", m, ["code", "period"], "v")
        assert got.columns == whole.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_located_share_with_repeats_and_nulls(spark):
    from panelweave.operators.keys import located_share

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0), ("x", 9.0)], "code string, v double")
    dim = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("unused",)], "code string")
    assert located_share(df, dim, "code", "v").collect() == [(3.0, 16.0, 1 - 3 / 16)]
    assert located_share(df, dim.limit(0), "code", "v").collect() == [(0.0, 16.0, 1.0)]
    assert located_share(df.limit(0), dim, "code", "v").collect() == [(0.0, None, None)]


def test_long_names_keep_their_tail(spark):
    from panelweave.operators.shape import to_long

    name = "p_" + "x" * 1500
    df = spark.createDataFrame([(1, 2)], f"id int, {name} int")
    assert to_long(df, ["id"], [name], prefix="p_").first()["name"] == "x" * 1500


def test_stages_after_a_mark_are_dropped(spark):
    from panelweave.session import drop_stages, stage, stage_mark

    kept = stage(spark.range(3), "kept")
    mark = stage_mark(spark)
    inner = stage(spark.range(4), "inner")
    last = stage(inner.filter("id > 1"), "last")
    assert drop_stages(spark, mark, keep_last=True) == 1
    assert (kept.count(), last.count()) == (3, 2)
    assert drop_stages(spark, mark) == 1 and stage_mark(spark) == mark
