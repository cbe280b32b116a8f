"""Prefix trie of sequences as a z-fast trie: a table of compacted nodes that is looked up by handle hashes.

A compacted node stands for an edge: the depths ``a < d <= b`` on which the same sequences run together. Its handle is the prefix
whose length is the two-fattest number in (a, b], the one that the largest power of two divides. The prefix of any sequence of length d
has a key, so "which node has this handle" is an equi-join, and the exit node of a sequence of length m is found in about log2(m)
joins (fat binary search) instead of one for every depth.

Sequences are inserted in batches. Each sequence of a batch is brought to its exit node; the edges left in their middle are expanded
to their depths, merged with the rest of the batch's sequences below, and compacted again. Nothing else of the trie is touched.

A sequence is never one row: its turns are rows, running sums over blocks of turns give the keys, and what is summed over subtrees goes
up in doubling steps over the compacted nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.llm.base import crc32_sql, table
from panelweave.operators.ranks import row_positions
from panelweave.session import stage

BLOCK = 12  # running sums are taken in blocks of 2^12 turns
LOW = (1 << 32) - 1
SUMS = ["s0", "s1", "s2", "s3"]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums))


ROOT = "52c5d56b1ff9a0b0e7cdd0e1d1b5fa6e"  # any text that is no key of a prefix; the root has no handle and is never looked up


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, key, up, bytes, cum): the key of every prefix and of the one before, bytes of the turn and of all turns so far.

    ``turns``: (c, d, token, bytes), d from 1 without gaps. A key holds exact sums of four 32-bit hashes of (depth, token) per turn, so a prefix
    sum needs no state but totals: blocks of turns are summed on their own and offset by the blocks before.
    """
    one, two = F.xxhash64("d", "token"), F.xxhash64("token", "d", F.lit("second"))
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(two, 32), two.bitwiseAND(F.lit(LOW))]
    rows = turns.select("c", "d", "bytes", F.shiftright(F.col("d") - 1, BLOCK).alias("block"), *[p.alias(f"o{i}") for i, p in enumerate(parts)])
    running = {"s0": "o0", "s1": "o1", "s2": "o2", "s3": "o3", "cum": "bytes"}
    inside = W.partitionBy("c", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("c", "d", "block", "bytes", *parts_of(), *[F.sum(v).over(inside).alias(k) for k, v in running.items()])
    summed = stage(summed, "turns")
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = summed.groupBy("c", "block").agg(*[F.max(k).alias(k) for k in running])
    offsets = totals.select(
        F.col("c").alias("c_of"), F.col("block").alias("block_of"), *[F.sum(k).over(before).alias(f"{k}_before") for k in running]).filter("block_of > 0")
    joined = summed.join(offsets, (F.col("c") == F.col("c_of")) & (F.col("block") == F.col("block_of")), "left")
    whole = {k: F.col(k) + F.coalesce(F.col(f"{k}_before"), F.lit(0)) for k in running}
    sums = [whole[s] for s in SUMS]
    last = [w - F.col(o) for w, o in zip(sums, running.values())]
    up = F.when(F.col("d") == 1, F.lit(ROOT)).otherwise(_key(F.col("d") - 1, last))
    return stage(joined.select("c", "d", _key(F.col("d"), sums).alias("key"), up.alias("up"), "bytes", whole["cum"].alias("cum")), "prefixes")


def parts_of() -> list[str]:
    return ["o0", "o1", "o2", "o3"]


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    top = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), top))


EDGE = "key string, b long, a long, up string, rep long, handle string, first string, cum long, cum_a long"


def _at(rows: DataFrame, x: DataFrame, where: dict[str, Column], c: str = "c") -> DataFrame:
    """``rows`` (with a unique ``c``) and, as structs by name, the prefix rows of that sequence at the given depths; NULL where it is shorter."""
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("d")) for n, d in where.items()])
    asked = rows.select(F.col(c).alias("c_of"), F.col("_id").alias("id_of"), F.explode(wanted).alias("w"))
    found = asked.join(x, (F.col("c_of") == F.col("c")) & (F.col("w.d") == F.col("d")))
    got = found.groupBy("id_of").agg(
        *[F.max(F.when(F.col("w.name") == n, F.struct("key", "cum", "bytes"))).alias(n) for n in where])
    return rows.join(got, F.col("_id") == F.col("id_of"), "left").drop("id_of")


def _locate(edges: DataFrame, x: DataFrame, seqs: DataFrame) -> DataFrame:
    """(c, len, base, base_len, edge): the deepest node a sequence reaches, and the edge it leaves or ends in (NULL if it starts a new one)."""
    state = seqs.select("c", "len", F.lit(0).cast("long").alias("lo"), F.col("len").alias("hi"), F.lit(ROOT).alias("at"))
    handles = edges.select(F.col("handle").alias("handle_of"), F.col("key").alias("node"), F.col("b").alias("node_b"))
    done = []
    while True:
        probe = state.withColumn("f", two_fattest(F.col("lo"), F.col("hi")))
        keyed = probe.join(x.select(F.col("c").alias("x_c"), F.col("d").alias("x_d"), F.col("key").alias("x_key")),
                           (F.col("c") == F.col("x_c")) & (F.col("f") == F.col("x_d")), "left")
        hit = keyed.join(handles, F.col("x_key") == F.col("handle_of"), "left")
        found = F.col("node").isNotNull()
        state = stage(hit.select(
            "c", "len", F.when(found, F.col("node_b")).otherwise(F.col("lo")).alias("lo"),
            F.when(found, F.col("hi")).otherwise(F.greatest(F.col("f") - 1, F.col("lo"))).alias("hi"), F.coalesce("node", "at").alias("at")), "search")
        done.append(state.filter("lo >= hi"))
        state = state.filter("lo < hi")
        if state.isEmpty():
            break
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    # the last node found has a handle the sequence runs through; does it run through the whole edge?
    nodes = edges.select(F.col("key").alias("at_of"), "a", "b", "up")
    known = ends.join(nodes, F.col("at") == F.col("at_of"), "left").withColumn("_id", F.col("c")).withColumn("b", F.coalesce("b", F.lit(0)))
    known = _at(known, x, {"there": F.col("b"), "next": F.col("b") + 1})
    whole = (F.col("at") == ROOT) | F.coalesce(F.col("there.key") == F.col("at"), F.lit(False))
    firsts = edges.select(F.col("first").alias("first_of"), F.col("key").alias("child"))
    out = known.withColumn("go", F.when(whole, F.col("next.key"))).join(firsts, F.col("go") == F.col("first_of"), "left")
    return stage(out.select(
        "c", "len", F.when(whole, F.col("at")).otherwise(F.col("up")).alias("base"), F.when(whole, F.col("b")).otherwise(F.col("a")).alias("base_len"),
        F.when(whole, F.col("child")).otherwise(F.col("at")).alias("edge")), "exits")


def expand(edges: DataFrame, x: DataFrame, keep: list[str]) -> DataFrame:
    """The prefix rows of the edges, each from its sequence ``rep``, with the kept columns of the edge; joined by block of depths."""
    e = edges.select("a", "b", F.col("rep"), *keep, F.explode(F.sequence(F.shiftright("a", BLOCK), F.shiftright(F.col("b") - 1, BLOCK))).alias("block_of"))
    rows = x.withColumn("block", F.shiftright(F.col("d") - 1, BLOCK))
    inside = (F.col("rep") == F.col("c")) & (F.col("block") == F.col("block_of")) & (F.col("d") > F.col("a")) & (F.col("d") <= F.col("b"))
    return e.join(rows, inside).drop("block", "block_of", "c")


def _insert(edges: DataFrame | None, x: DataFrame, seqs: DataFrame) -> DataFrame:
    """The compacted edges with the sequences of one batch inserted."""
    if edges is None:
        exits = seqs.select("c", "len", F.lit(ROOT).alias("base"), F.lit(0).cast("long").alias("base_len"), F.lit(None).cast("string").alias("edge"))
    else:
        exits = _locate(edges, x, seqs)
    new = exits.select(F.col("c").alias("rep"), F.col("base_len").alias("a"), F.col("len").alias("b"), "base").filter("b > a")
    rows = new.join(x, (F.col("rep") == F.col("c")) & (F.col("d") > F.col("a"))).select(
        "rep", "d", "key", "up", "bytes", "cum", F.lit("").alias("path"), F.col("a").alias("base_len"), "base", (F.col("d") == F.col("b")).alias("end"))
    if edges is not None:
        hit = exits.filter("edge IS NOT NULL").select(F.col("edge").alias("of")).distinct()
        opened = stage(edges.join(hit, F.col("key") == F.col("of"), "left_semi"), "opened")
        inner = expand(opened.select("a", "b", "rep", F.col("key").alias("path"), F.col("up").alias("base")), x, ["path", "base"])
        rows = rows.unionByName(inner.select(
            "rep", "d", "key", "up", "bytes", "cum", "path", F.col("a").alias("base_len"), "base", (F.col("d") == F.col("b")).alias("end")))
    rows = stage(rows, "open")
    nodes = rows.groupBy("key", "up").agg(F.max("end").alias("end"))
    kids = nodes.groupBy(F.col("up").alias("of")).agg(F.count(F.lit(1)).alias("kids"))
    stops = nodes.join(kids, F.col("key") == F.col("of"), "left").filter(F.col("end") | (F.col("kids") > 1)).select(F.col("key").alias("stop"))
    on = W.partitionBy("path", "rep").orderBy("d")
    marks = rows.join(stops, F.col("key") == F.col("stop")).select(
        "key", "d", "rep", F.coalesce(F.lag("d").over(on), "base_len").alias("a"), F.coalesce(F.lag("key").over(on), "base").alias("up"), "cum")
    made = marks.groupBy("key").agg(F.min("rep").alias("rep"), F.min("d").alias("b"), F.min("a").alias("a"), F.min("up").alias("up"), F.min("cum").alias("cum"))
    made = _at(made.withColumn("_id", F.col("key")), x, {"fat": two_fattest(F.col("a"), F.col("b")), "start": F.col("a") + 1}, "rep")
    made = made.select("key", "b", "a", "up", "rep", F.col("fat.key").alias("handle"), F.col("start.key").alias("first"), "cum",
                       (F.col("start.cum") - F.col("start.bytes")).alias("cum_a"))
    if edges is not None:
        made = made.unionByName(edges.join(opened.select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_anti"))
    return stage(made, "edges")


def build_trie(x: DataFrame, seqs: DataFrame, shares: tuple[float, ...] = (0.25, 1.0)) -> DataFrame:
    """(key, b, a, up, rep, handle, first, cum, cum_a): the compacted edges over all sequences (c, len), inserted in batches.

    ``shares`` are the cumulated parts of the batches; a sequence falls into one by a hash of its id, and the result does not depend on them.
    """
    place, edges, low = F.pmod(F.xxhash64("c"), F.lit(1 << 20)), None, 0
    for share in shares:
        high = int(share * (1 << 20))
        edges = _insert(edges, x, seqs.filter((place >= low) & (place < high)))
        low = high
    return edges


def subtree_totals(nodes: DataFrame, totals: dict[str, str]) -> DataFrame:
    """(node, one column per entry of ``totals``): the sum or least value over the node and all below.

    ``nodes``: (node, parent or NULL, columns). After k steps a row holds its subtree down to 2^k levels and points 2^k levels up.
    """
    names = list(totals)
    state = nodes.select("node", "parent", *names)
    while True:
        state = stage(state, "totals")
        if state.filter("parent IS NOT NULL").isEmpty():
            return state.drop("parent")
        pick = {"sum": F.sum, "min": F.min}
        add = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("to")).agg(*[pick[h](n).alias(f"{n}_add") for n, h in totals.items()])
        hop = state.select(F.col("node").alias("via"), F.col("parent").alias("next"))
        both = state.join(add, F.col("node") == F.col("to"), "left").join(hop, F.col("parent") == F.col("via"), "left")
        one = {"sum": lambda n: F.col(n) + F.coalesce(F.col(f"{n}_add"), F.lit(0)), "min": lambda n: F.least(n, f"{n}_add")}
        state = both.select("node", F.col("next").alias("parent"), *[one[h](n).alias(n) for n, h in totals.items()])


def _id_lists(ends: DataFrame) -> DataFrame:
    """(node, ids_sha256): SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are distinct, so a piece of a range of 2^12 ids is bounded; a node with one piece is hashed as it is, the pieces of others are fed to
    the hash in order, one after the other.
    """
    import hashlib

    import pyarrow as pa

    pieces = ends.groupBy("node", F.shiftright("c", BLOCK).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda i: i.cast("string")), ",").alias("ids"))
    pieces = stage(pieces, "pieces")
    count = pieces.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    counted = pieces.join(count, F.col("node") == F.col("of"))
    short = counted.filter("n = 1").select("node", F.sha2("ids", 256).alias("ids_sha256"))

    def feed(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([{"node": a, "ids_sha256": b} for a, b in out])
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ids_sha256": state.hexdigest()}])

    long = counted.filter("n > 1").select("node", "piece", "ids").repartition("node").sortWithinPartitions("node", "piece")
    return short.unionByName(long.mapInArrow(feed, "node string, ids_sha256 string"))


def trie_nodes(turns: DataFrame, ids: DataFrame, shares: tuple[float, ...] = (0.25, 1.0)) -> DataFrame:
    """One row per node: (id, depth, parent_id, n_members, n_children, n_leaves, saved_bytes, ends_sha256), all but the last long.

    ``turns``: (c, d, token, bytes), d from 1 without gaps; ``ids``: (c), every sequence once, those without turns too. id is the least member, and
    (id, depth) is unique. saved_bytes sums (members - 1) * bytes of the last turn over the subtree. Without a sequence there is no row.
    """
    x = prefixes(turns)
    lengths = x.groupBy(F.col("c").alias("c_of")).agg(F.max("d").alias("len"))
    seqs = stage(ids.join(lengths, F.col("c") == F.col("c_of"), "left").select("c", F.coalesce("len", F.lit(0)).alias("len")), "sequences")
    edges = build_trie(x, seqs, shares)
    last = seqs.filter("len > 0").join(x.select(F.col("c").alias("x_c"), "d", "key"), (F.col("c") == F.col("x_c")) & (F.col("len") == F.col("d")))
    ends = stage(last.select("c", F.col("key").alias("node")).unionByName(seqs.filter("len = 0").select("c", F.lit(ROOT).alias("node"))), "ends")
    ended = ends.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("members"), F.min("c").alias("id"))
    kids = edges.groupBy(F.col("up").alias("kids_of")).agg(F.count(F.lit(1)).alias("kids"))
    root = seqs.limit(1).select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "cum", "cum_a")],
        F.lit(None).cast("long").alias("rep"))
    nodes = edges.select(F.col("key").alias("node"), F.col("up").alias("parent"), "a", "b", "cum", "cum_a", "rep").unionByName(root)
    nodes = nodes.join(ended, F.col("node") == F.col("of"), "left").join(kids, F.col("node") == F.col("kids_of"), "left").select(
        "node", "parent", "a", "b", "cum", "cum_a", "rep", F.coalesce("members", F.lit(0)).alias("members"), "id", F.coalesce("kids", F.lit(0)).alias("kids"),
        F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    nodes = stage(nodes, "nodes")
    below = subtree_totals(nodes, {"members": "sum", "id": "min", "leaves": "sum"})
    nodes = stage(nodes.drop("members", "id", "leaves").join(below, "node"), "nodes").withColumn("saved", (F.col("members") - 1) * (F.col("cum") - F.col("cum_a")))
    saved = subtree_totals(nodes, {"saved": "sum"})
    above = nodes.select(F.col("node").alias("above"), F.col("id").alias("above_id"))
    full = stage(nodes.drop("saved").join(saved, "node").join(above, F.col("parent") == F.col("above"), "left").join(
        _id_lists(ends).withColumnRenamed("node", "ids_of"), F.col("node") == F.col("ids_of"), "left"), "nodes")
    none = F.sha2(F.lit(""), 256)
    facts = ["id", "above_id", "members", "kids", "leaves", "saved", "ids_sha256", "cum_a"]
    inner = expand(full.filter("rep IS NOT NULL").withColumnRenamed("cum", "cum_b"), x, facts)
    at_end = F.col("d") == F.col("b")
    rows = inner.select(
        "id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("a") + 1, F.col("above_id")).otherwise(F.col("id")).alias("parent_id"),
        F.col("members").alias("n_members"), F.when(at_end, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("members") - 1) * (F.col("cum") - F.col("bytes") - F.col("cum_a"))).alias("saved_bytes"),
        F.coalesce(F.when(at_end, F.col("ids_sha256")), none).alias("ends_sha256"))
    top = full.filter("rep IS NULL").select(
        "id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_id"), F.col("members").alias("n_members"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_bytes"), F.coalesce("ids_sha256", none).alias("ends_sha256"))
    return rows.unionByName(top)


def ordered_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, position, total, token, bytes): a conversation's turns by turn (NULL first), then by the hash of role and text.

    The token is a hash of (role, text), each with its length before it; NULL becomes empty. Rows with a NULL conversation are left out; repeated
    rows are turns of their own. Other columns are not read.
    """
    who, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    token = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256)
    small = rows.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), token.alias("token"), F.octet_length(what).cast("long").alias("bytes"))
    return row_positions(small, ["turn", "token"], ["c"]).drop("turn")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    own = stage(ordered_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"), "ordered")
    ids = own.groupBy("c").agg(F.max("total").alias("total"))
    ids = ids.select("c", "total", (F.col("c") - F.col("c") % 5).alias("source"), (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"))
    sizes = ids.select(F.col("c").alias("size_of"), F.col("total").alias("source_total"))
    ids = stage(ids.join(sizes, F.col("source") == F.col("size_of"), "left").select(
        "c", "source", "h", F.least("h", F.coalesce("source_total", F.lit(0))).alias("head")), "rebuilt")
    # a source has nine ids at most that take their first turns from it, and gives eight turns at most
    takers = own.filter("position <= 8").select(
        F.col("c").alias("from"), "position", "token", "bytes", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("c") + k)).alias("to"))
    head = takers.join(ids, (F.col("to") == F.col("c")) & (F.col("from") == F.col("source")) & (F.col("position") <= F.col("h")))
    to = ids.select(F.col("c").alias("to"), "h", "head")
    tail = own.join(to, F.col("c") == F.col("to")).filter("position > h").select("c", (F.col("head") + F.col("position") - F.col("h")).alias("d"), "token", "bytes")
    turns = head.select("c", F.col("position").alias("d"), "token", "bytes").unionByName(tail)
    return trie_nodes(turns, ids.select("c")).select(
        F.col("id").alias("conv_id"), "depth", F.col("parent_id").alias("parent_conv_id"), F.col("n_members").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(CAST(octet_length(encode(r)) AS VARCHAR) || ':' || r || x) AS k, octet_length(encode(x)) AS b
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT c, k, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p, count(*) OVER (PARTITION BY c) AS n FROM t),
i AS (SELECT a.c, a.c - a.c % 5 AS source, {crc32_sql('CAST(a.c AS VARCHAR)')} % 9 AS h, coalesce(s.n, 0) AS m
      FROM (SELECT DISTINCT c FROM o) a LEFT JOIN (SELECT DISTINCT c, n FROM o) s ON s.c = a.c - a.c % 5),
r AS (SELECT i.c, o.p AS d, k, b FROM i JOIN o ON o.c = i.source AND o.p <= i.h
      UNION ALL SELECT i.c, least(h, m) + o.p - h, k, b FROM i JOIN o ON o.c = i.c AND o.p > i.h),
x AS (SELECT c, d, b, md5(string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key FROM r
      UNION ALL SELECT c, 0, 0, '' FROM i),
e AS (SELECT c, max(d) AS len FROM x GROUP BY c),
y AS (SELECT x.*, lag(key) OVER (PARTITION BY x.c ORDER BY d) AS up, d = len AS stop FROM x JOIN e ON x.c = e.c),
n AS (SELECT key, d, min(up) AS up, min(b) AS b, min(c) AS c, count(*) AS n,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (stop), '')) AS ends FROM y GROUP BY key, d),
q AS (SELECT n.*, count(k.key) AS kids FROM n LEFT JOIN n k ON k.up = n.key AND k.d = n.d + 1 GROUP BY ALL),
g AS (SELECT y.key, y.d, sum((q.n - 1) * q.b) AS saved, count(*) FILTER (q.kids = 0) AS leaves
      FROM q JOIN y ON y.c = q.c AND y.d <= q.d GROUP BY y.key, y.d)
SELECT q.c AS conv_id, CAST(q.d AS BIGINT) AS depth, w.c AS parent_conv_id, q.n AS n_convs, q.kids AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves,
       CAST(g.saved AS BIGINT) AS saved_tokens, q.ends AS ends_sha256
FROM q JOIN g ON g.key = q.key AND g.d = q.d LEFT JOIN n w ON w.key = q.up AND w.d = q.d - 1
"""
