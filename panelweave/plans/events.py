"""Event tables: reconciling sources and repairing codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelweave.operators.keys import count_candidates, first_by, located_share, non_members, recode_sums, unmatched_keys
from panelweave.operators.shape import union_named
from panelweave.session import stage


def event_reconcile(
    *sources: DataFrame, unit: str = "unit", period: str = "period", value: str = "events"
) -> DataFrame:
    """Mean over the distinct values that the sources report for a unit and period.

    Distinct first: partial aggregation removes the copies before the shuffle.
    """
    rows = union_named(*[s.select(unit, period, value) for s in sources])
    rows = rows.filter(F.col(unit).isNotNull() & F.col(value).isNotNull()).distinct()
    return rows.groupBy(unit, period).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_values"))


def repair_evidence(
    lost: DataFrame, dim: DataFrame, names: list[DataFrame], block_of: DataFrame, overrides: DataFrame, blacklist: DataFrame,
    code: str = "code", prefix_len: int = 2,
) -> DataFrame:
    """Everything that is known about where a lost code belongs, ranked: (from, rank, source, block_by, block, n_candidates, to, outcome).

    A row per name source that has the code (its first row) and per way to find the block: by an override on the area, by one on the place, by the
    place. The outcome is ``match``, or what is missing: ``no name``, ``no block``, ``no candidate``, ``several candidates``, ``blacklisted``. ``to`` is set
    for a match only. A code that no source names has one row of rank 0. The lost codes
    and their names are written once, since the matching and the search for codes without a name both read them.
    """
    one_block = block_of.filter("place IS NOT NULL").groupBy("place").agg(F.min("block").alias("_place_block"))
    rules = {c: overrides.filter(F.col("field") == c).groupBy(F.col("match").alias(c)).agg(F.max("block").alias(f"_{c}_rule")) for c in ("place", "area")}
    lost = stage(lost.select(code), "lost")
    rows = []
    for i, src in enumerate(names, 1):
        have = [c if c in src.columns else F.lit(None).cast("string").alias(c) for c in ("name", "place", "area")]
        first = first_by(src.filter(F.col(code).isNotNull()), [code], ["row"], [c for c in ("name", "place", "area") if c in src.columns])
        rows.append(lost.join(first, code).select(F.col(code).alias("from"), F.lit(i).alias("source"), *have))
    named = stage(union_named(*rows), "named")
    rows = named.join(one_block, "place", "left").join(rules["place"], "place", "left").join(rules["area"], "area", "left")
    ways = [("area override", "_area_rule"), ("place override", "_place_rule"), ("place", "_place_block")]
    way = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("block_by"), F.col(c).alias("block")) for k, (n, c) in enumerate(ways)]),
        lambda w: w["block"].isNotNull())
    none = F.array(F.struct(F.lit(len(ways)).alias("k"), F.lit(None).cast("string").alias("block_by"), F.lit(None).cast("string").alias("block")))
    rows = rows.withColumn("_w", F.explode(F.when(F.size(way) > 0, way).otherwise(none)))
    rows = rows.select("from", "source", "name", (F.col("source") * (len(ways) + 1) + F.col("_w.k")).alias("rank"), "_w.block_by", "_w.block")
    counted = count_candidates(rows, dim, code, "name", "block", prefix_len)
    black = blacklist.select(F.col(code).alias("to"), F.lit(True).alias("_black")).distinct()
    outcome = (
        F.when(F.col("name").isNull(), "no name").when(F.col("block").isNull(), "no block").when(F.col("n_candidates") == 0, "no candidate")
        .when(F.col("n_candidates") > 1, "several candidates").when(F.col("_black"), "blacklisted").otherwise("match")
    )
    judged = counted.join(black, "to", "left").withColumn("outcome", outcome)
    listed = judged.select(
        "from", "rank", "source", "block_by", "block", "n_candidates", F.when(F.col("outcome") == "match", F.col("to")).alias("to"), "outcome")
    unnamed = non_members(lost.select(F.col(code).alias("from")), named, ["from"])
    return union_named(listed, unnamed.select("from", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("n_candidates"), F.lit("no name").alias("outcome")))


def judge_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit, conflicts). Audit: the evidence of least rank per code, which alone decides, with rule ``name`` or ``unresolved``.

    Conflicts: evidence of higher rank that leads to another code, or to one where the deciding evidence leads to none.
    """
    facts = ["rank", "source", "block_by", "block", "n_candidates", "to", "outcome"]
    best = evidence.groupBy("from").agg(F.min(F.struct(*facts)).alias("b"))
    rule = F.when(F.col("b.to").isNotNull(), "name").otherwise("unresolved")
    audit = best.select("from", F.col("b.to").alias("to"), rule.alias("rule"), "b.source", "b.block_by", "b.n_candidates", "b.outcome")
    taken = best.select(F.col("from").alias("_from"), F.col("b.rank").alias("_rank"), F.col("b.to").alias("chosen"))
    other = evidence.filter("`to` IS NOT NULL").join(taken, (F.col("from") == F.col("_from")) & (F.col("rank") > F.col("_rank")))
    conflicts = other.filter(~F.col("to").eqNullSafe(F.col("chosen"))).select("from", "chosen", "to", "source", "block_by", "block")
    return audit, conflicts


def code_repair(
    facts: DataFrame, dim: DataFrame, names: list[DataFrame], block_of: DataFrame, overrides: DataFrame,
    blacklist: DataFrame, code: str = "code", period: str = "period", value: str = "events", prefix_len: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired facts, audit of (from, to, rule), located share). ``repair_evidence`` gives what each rule rests on.

    ``dim``: code, name, block. ``names``: sources with code, row, name and optionally
    place and area. ``block_of``: (place, block), of which the least block of a place counts. ``overrides``: (field, match, block),
    tried on area, then place; a NULL or absent override leaves the block as found.
    Facts (summed per code and period), the evidence and the mapping are written once, since the repaired
    facts, the audit and the share all read them.
    """
    facts = stage(facts.groupBy(code, period).agg(F.sum(value).alias(value)), "facts")
    lost = unmatched_keys(facts, dim, code)
    audit = judge_evidence(stage(repair_evidence(lost, dim, names, block_of, overrides, blacklist, code, prefix_len), "evidence"))[0]
    mapping = stage(audit.filter("`to` IS NOT NULL").select("from", "to"), "mapping")
    repaired = recode_sums(facts, code, mapping, [code, period], value)
    return repaired, audit.select("from", "to", "rule"), located_share(repaired, dim, code, value)
