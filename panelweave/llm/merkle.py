"""Merkle tree of a dataset: manifest, membership proofs and their check.

Every row is a leaf. The leaves of a group, in order, are paired level by level to the group's subroot, and the subroots
of all groups to the root. Only every ``STEP``-th level is stored (checkpoint-and-recompute): a stored level holds the
nodes from which the aligned subtrees of 2^STEP nodes above it are made again when a proof is asked for. A proof takes the
siblings from the regenerated nodes, which are dropped with the row that held them.

The place of a leaf comes from a range partition, so a group may hold any part of the rows; no task sees more than one
aligned subtree at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import crc32_sql, table
from panelweave.operators.ranks import row_positions
from panelweave.session import stage

STEP = 6
RUN = 1 << STEP


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length before it, so that neighbouring values can't be confused; ``-`` for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def _up(nodes: Column) -> Column:
    """The level above: pairs of nodes, the last one alone if their number is odd."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _levels(nodes: Column, height: Column) -> Column:
    """[nodes, the level above, ...]: ``height`` levels above the given one."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(STEP - 1)), F.array(nodes),
        lambda a, i: F.when(i < height, F.concat(a, F.array(_up(F.element_at(a, -1))))).otherwise(a),
    )


def _height(n: Column) -> Column:
    """Levels from a stored level of ``n`` nodes to the next one, or to the group's top if that comes first."""
    return F.when(n == 1, 0).otherwise(F.least(F.lit(STEP), F.length(F.bin(n - 1))))


@dataclass
class MerkleTree:
    """Stored levels of a tree per group. ``levels[k]``: (g, at, n, h), at counting from 0 and n being the level's nodes in the group."""

    levels: list[DataFrame]
    tops: DataFrame  # (g, h), one row per group


def _runs(level: DataFrame) -> DataFrame:
    """(g, run, n, nodes, rows): the nodes and rows of an aligned subtree, ``RUN`` at most, in order."""
    run = F.shiftright("at", STEP).alias("run")
    rows = level.groupBy("g", run).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", *[c for c in level.columns if c not in ("g", "at", "n")]))).alias("rows"))
    return rows.withColumn("nodes", F.transform("rows", lambda x: x["h"]))


def build_tree(leaves: DataFrame) -> MerkleTree:
    """The stored levels above the written table ``leaves``: (g, at, n, h, other columns), one row per leaf; g may be NULL."""
    levels, tops = [leaves], []
    while True:
        runs = _runs(levels[-1].select("g", "at", "n", "h"))
        top = F.element_at(F.element_at(_levels(F.col("nodes"), _height(F.col("n"))), -1), 1)
        made = runs.withColumn("h", top).select("g", F.col("run").alias("at"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), "h")
        made = stage(made, "merkle")
        tops.append(made.filter("n = 1").select("g", "h"))
        if made.filter("n > 1").isEmpty():
            break
        levels.append(made.filter("n > 1"))
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return MerkleTree(levels, stage(whole, "tops"))


def proofs(tree: MerkleTree) -> DataFrame:
    """The leaves with ``path``: their siblings from the bottom to the group's top, made from the stored levels alone.

    A path entry is (sibling or NULL where the node is alone, whether the node is the right one of its pair). Each run of a stored
    level regenerates the nodes of its subtree, and meets the rest of the way its nodes share from the level above.
    """
    rest = None
    for level in reversed(tree.levels):
        runs = _runs(level)
        if rest is None:
            runs = runs.withColumn("rest", F.lit(None).cast("array<struct<sibling:string,right:boolean>>"))
        else:
            shared = rest.select(F.col("g").alias("rest_g"), F.col("at").alias("rest_at"), F.col("path").alias("rest"))
            runs = runs.join(shared, F.col("g").eqNullSafe(F.col("rest_g")) & (F.col("run") == F.col("rest_at")), "left")
        made = runs.withColumn("below", _levels(F.col("nodes"), _height(F.col("n")))).withColumn(
            "below", F.slice("below", F.lit(1), F.size("below") - 1)).withColumn("rest", F.coalesce("rest", F.array()))

        def path(i: Column) -> Column:
            def step(nodes: Column, k: Column) -> Column:
                at = F.call_function("shiftright", i, k)
                return F.struct(F.get(nodes, at.bitwiseXOR(F.lit(1))).alias("sibling"), (at.bitwiseAND(F.lit(1)) == 1).alias("right"))

            return F.concat(F.transform("below", step), F.col("rest"))

        each = F.transform("rows", lambda x, i: F.struct(x.alias("x"), path(i).alias("path")))
        own = made.select("g", "n", F.explode(each).alias("e")).select("g", "n", "e.x.*", "e.path")
        rest = own if level is tree.levels[0] else stage(own, "paths")
    return rest


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def step(h: Column, s: Column) -> Column:
        other = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["right"], F.concat(other, h)).otherwise(F.concat(h, other)), 256)

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The siblings of a path in order, joined."""
    return F.array_join(F.transform(path, lambda s: s["sibling"]), "")


def manifest(rows: DataFrame, values: list[str], order: str, group: str, tampered: dict[str, Column] | None = None) -> DataFrame:
    """The rows with leaf, subroot, root, path, other_leaf (the leaf over ``tampered`` columns) and folded_root.

    ``path`` has the siblings from the leaf over the subroot to the root. Leaves of a group ascend by ``order`` (NULL first), rows that
    tie by their leaf; rows equal in all values are leaves of their own. Groups ascend bytewise, NULL first and a group like any
    other. Only the named columns are read, so others may have any name; an empty table gives no rows.
    """
    tampered = tampered or {}
    columns = [F.col(f"`{c}`") for c in values]
    changed = [tampered.get(c, F.col(f"`{c}`")) for c in values]
    small = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{order}`").alias("o"), leaf(columns).alias("h"), leaf(changed).alias("t"))
    placed = row_positions(small, ["o", "h"], ["g"]).select("g", (F.col("position") - 1).alias("at"), F.col("total").alias("n"), "h", "o", "t")
    tree = build_tree(stage(placed, "leaves"))
    crowns = row_positions(tree.tops, ["g"]).select(
        F.lit(None).cast("int").alias("g"), (F.col("position") - 1).alias("at"), F.col("total").alias("n"), "h", F.col("g").alias("of"))
    crown = build_tree(stage(crowns, "crowns"))
    upper = stage(proofs(crown).select("of", F.col("h").alias("subroot"), F.col("path").alias("crown_path")), "crowns")
    path = F.concat("path", "crown_path")
    whole = proofs(tree).join(upper, F.col("g").eqNullSafe(F.col("of"))).withColumn("root", crown.tops.select("h").scalar())
    return whole.select(
        F.col("g").alias(group), F.col("o").alias(order), F.col("h").alias("leaf"), "subroot", "root", path.alias("path"),
        F.col("t").alias("other_leaf"), fold(F.col("t"), path).alias("folded_root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    rows = manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", more)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _enc(c: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_enc(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_other FROM documents),
e AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS h, {_leaf_sql('n_other')} AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM e),
t AS (SELECT lang, 0 AS l, i, h FROM p UNION ALL
      SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM t) WHERE c > 1 GROUP BY lang, l, i // 2),
s AS (SELECT lang, l AS top, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM (SELECT *, max(l) OVER (PARTITION BY lang) AS m FROM t) WHERE l = m),
u AS (SELECT 0 AS l, i, h FROM s UNION ALL
      SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM u) WHERE c > 1 GROUP BY l, i // 2),
r AS (SELECT l AS top, h FROM u WHERE l = (SELECT max(l) FROM u)),
lo AS (SELECT q.lang, q.i, l, CAST((q.i >> l) & 1 AS VARCHAR) || coalesce(t.h, '') AS s
       FROM (SELECT p.lang, p.i, unnest(range(s.top)) AS l FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang) q
       LEFT JOIN (SELECT lang AS tl, l AS ll, i AS ti, h FROM t) t ON tl IS NOT DISTINCT FROM q.lang AND ll = q.l AND ti = xor(q.i >> q.l, 1)),
hi AS (SELECT q.lang, l, CAST((q.i >> l) & 1 AS VARCHAR) || coalesce(t.h, '') AS s
       FROM (SELECT lang, i, unnest(range(r.top)) AS l FROM s, r) q LEFT JOIN (SELECT l AS ll, i AS ti, h FROM u) t ON ll = q.l AND ti = xor(q.i >> q.l, 1)),
la AS (SELECT lang, i, list(s ORDER BY l) AS a FROM lo GROUP BY lang, i), ha AS (SELECT lang, list(s ORDER BY l) AS a FROM hi GROUP BY lang),
f AS (SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, p.other, list_concat(coalesce(la.a, []), coalesce(ha.a, [])) AS a
      FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r LEFT JOIN la ON la.lang IS NOT DISTINCT FROM p.lang AND la.i = p.i
      LEFT JOIN ha ON ha.lang IS NOT DISTINCT FROM p.lang)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(a, lambda x: x[2:])), 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce(list_concat([other], a), lambda h, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root FROM f)
"""
