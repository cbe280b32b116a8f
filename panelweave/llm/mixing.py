"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are summed by membership pattern, the set of sources they belong to. Each
pattern offers its words once at cost 0 and each repetition at a growing cost (1, 3, 5, ...: convex). The cheapest flow
of words from patterns to source quotas says how many words of a pattern to take for which
source. Then documents are chosen inside a pattern in a seeded order: every document is taken as often as the
flow goes around the pattern, and those up to a cut of the order once more. The last one may be taken in part, so quotas
are met to the word.

The flow has one node per pattern and source. Patterns are a property of how sources overlap, not of the number of documents;
they are refused beyond ``PATTERN_LIMIT``, never cut.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.llm.base import WORD, table
from panelweave.session import stage

PATTERN_LIMIT = 100_000
BINS = 16


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """``share`` of all words by weight; no source above ``most`` times its size, the excess shared again by weight until none is above."""
    left, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        unit = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: w * unit for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def route(capacity: dict[tuple, int], quota: dict, copies: int = 2) -> dict[tuple, dict]:
    """pattern -> {source: words}, the cheapest flow: ``copies`` uses of each pattern's words at costs 0, 1, 3, 5, ...

    Layer by layer, as a layer's cost is above all before it; inside a layer along shortest augmenting paths, which may move
    words that another source holds. Patterns of one source are filled first, as their words can go nowhere else.
    """
    flow = {p: dict.fromkeys(p, 0) for p in capacity}
    need = {s: int(round(q)) for s, q in quota.items()}
    members: dict = {}
    for p in capacity:
        for s in p:
            members.setdefault(s, []).append(p)
    used = dict.fromkeys(capacity, 0)
    for layer in range(copies):
        limit = {p: c * (layer + 1) for p, c in capacity.items()}
        for p in sorted(capacity, key=len):
            if len(p) == 1:
                step = min(limit[p] - used[p], need[p[0]])
                flow[p][p[0]] += step
                used[p] += step
                need[p[0]] -= step
        for s in sorted(need, key=str):
            while need[s] > 0:
                path = _path(s, members, flow, used, limit)
                if path is None:
                    break
                # path: source, pattern, source, ..., pattern with room; words move along it
                step = min([need[s], limit[path[-1]] - used[path[-1]]] + [flow[path[i]][path[i + 1]] for i in range(1, len(path) - 1, 2)])
                for i in range(0, len(path), 2):
                    flow[path[i + 1]][path[i]] += step
                    if i:
                        flow[path[i - 1]][path[i]] -= step
                used[path[-1]] += step
                need[s] -= step
    return flow


def _path(source, members, flow, used, limit):
    """Shortest way from a source short of words to a pattern with room, over patterns whose words other sources hold."""
    queue, came = [(0, 0, source)], {source: None}
    tick = 0
    while queue:
        depth, _, s = heapq.heappop(queue)
        for p in members.get(s, []):
            if ("p", p) in came:
                continue
            came["p", p] = s
            if used[p] < limit[p]:
                path, at = [p], s
                while at is not None:
                    path.append(at)
                    before = came[at]
                    if before is None:
                        break
                    path.append(before)
                    at = came["p", before]
                return path[::-1]
            for other, words in flow[p].items():
                if words > 0 and other not in came:
                    came[other] = p
                    tick += 1
                    heapq.heappush(queue, (depth + 1, tick, other))
    return None


def _order_key(doc_id: Column, text: Column, seed: str) -> Column:
    digest = F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str, text: str, sources: Column, quota, copies: int = 2, seed: str = "mix") -> DataFrame:
    """All rows of ``docs`` with (size, taken) in a struct column ``mix`` beside the columns in ``row``.

    ``sources`` is the array of a row's sources; NULL elements stand for the source NULL, no source at all takes nothing.
    ``quota`` maps {source: words} to {source: words to take}. Rows of equal id and text are equal in order and may be taken in part in any
    of them. A NULL text has size 0. An empty table gives no rows. Rows must come the same on a second reading.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), s.cast("string")), F.lit("~"))))).alias("pattern"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _order_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"), seed).alias("at"),
    )
    shift = 52 - BINS
    binned = rows.groupBy("pattern", F.shiftright("at", shift).alias("bin")).agg(F.sum("size").alias("words"))
    bins = stage(binned, "bins")
    sums = bins.groupBy("pattern").agg(F.sum("words").alias("words")).orderBy("pattern").limit(PATTERN_LIMIT + 1).collect()
    if len(sums) > PATTERN_LIMIT:
        raise ValueError(f"more than {PATTERN_LIMIT} membership patterns")
    capacity = {tuple(r["pattern"]): r["words"] for r in sums if r["pattern"]}
    names = sorted({s for p in capacity for s in p}, key=lambda s: (s == "~", s))
    sizes = {s: sum(c for p, c in capacity.items() if s in p) for s in names}
    plain = {s: None if s == "~" else s[1:] for s in names}
    wanted = quota({plain[s]: sizes[s] for s in names})
    flow = route(capacity, {s: wanted[plain[s]] for s in names}, copies)
    plan = docs.sparkSession.createDataFrame(
        [(list(p), c, sum(flow[p].values())) for p, c in capacity.items()] or [([], 0, 0)], "pattern array<string>, capacity long, take long"
    ).select("pattern", F.expr("CASE WHEN capacity > 0 THEN take div capacity ELSE 0 END").alias("rounds"),
             F.expr("CASE WHEN capacity > 0 THEN take % capacity ELSE 0 END").alias("rest"))
    # the bin in which the order passes the rest, and the words before it
    before = F.sum("words").over(W.partitionBy("pattern").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    cuts = bins.select("pattern", "bin", "words", before.alias("before")).join(plan, "pattern").filter(
        (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    ).select("pattern", F.col("bin").alias("cut"), F.col("before"))
    frame = stage(plan.join(cuts, "pattern", "left"), "plan")
    cut_rows = rows.join(F.broadcast(frame), "pattern").filter(F.shiftright("at", shift) == F.col("cut")).select("pattern", "at", "size", "before", "rest")
    # rows of the cut bin, a 65,536th of a pattern: those of one place in the order go together
    places = cut_rows.groupBy("pattern", "at").agg(F.sum("size").alias("words"), F.max("before").alias("before"), F.max("rest").alias("rest"), F.count(F.lit(1)).alias("same"))
    so_far = F.col("before") + F.sum("words").over(W.partitionBy("pattern").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    edge = places.select("pattern", "at", "words", "rest", so_far.alias("start")).filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") >= F.col("rest")))
    edges = stage(edge.select("pattern", F.col("at").alias("edge"), (F.col("rest") - F.col("start")).alias("part"), F.col("words").alias("whole")), "edges")
    known = rows.join(F.broadcast(frame.join(edges, "pattern", "left")), "pattern", "left")
    extra = (
        F.when(F.col("rest") <= 0, F.lit(0))
        .when(F.col("at") < F.col("edge"), F.col("size"))
        .when(F.col("at") == F.col("edge"), F.expr("size * part div whole"))
        .otherwise(F.lit(0))
    )
    taken = F.coalesce(F.col("rounds"), F.lit(0)) * F.col("size") + F.coalesce(extra, F.lit(0))
    return known.select("row", F.struct("size", taken.cast("long").alias("taken")).alias("mix"))


def source_quota(share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)):
    """Quota function: weights repeat over the sources by code point, NULL last."""
    def quota(sizes: dict) -> dict:
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        return targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, most)

    return quota


def mix_sources(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows as of ``mix``, (source, source_size, target)) with each row in its one source and the default quota."""
    kept: dict = {}

    def quota(sizes: dict) -> dict:
        wanted = source_quota()(sizes)
        kept.update({s: (n, wanted[s]) for s, n in sizes.items()})
        return wanted

    mixed = mix(docs, doc_id, text, F.array(F.col(f"`{source}`")), quota)
    listed = docs.sparkSession.createDataFrame([(s, int(n), float(t)) for s, (n, t) in kept.items()], "source string, source_size long, target double")
    return mixed, listed


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed, listed = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    rows = mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("own"), "mix.*")
    return rows.join(F.broadcast(listed), F.col("own").eqNullSafe(F.col("source"))).select("doc_id", "size", "source_size", "target", "taken")
