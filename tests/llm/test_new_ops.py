"""Exact stream dedup, prefix trie and Merkle manifest against brute force and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelweave.llm import exact_stream as X, merkle as M, zfast_trie as Z


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def place(r):
    return r.file.rsplit("/", 1)[-1], r.row


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Repeated ids, NULLs, ties, a long text and clashing extra columns, over several files."""
    path = str(tmp_path_factory.mktemp("exact") / "documents.parquet")
    rng = random.Random(1)
    words = ["a", "A", "b", "É", "é", None, "", "c d", "C D", "x" * 300_000, "zz"]
    rows = [(rng.randrange(60) if i % 9 else None, rng.choice(words)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "file", "row", "digest", "id", "keep")})
    df.repartition(5).write.parquet(path)
    return path


def classes(spark, path):
    rows = spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    out = defaultdict(dict)
    for r in rows:
        out[lowered(r.text)][place(r)] = r.doc_id
    return out


# digests that different texts share: none, the first hex digit of a checksum, one for all
DIGESTS = [X.sha256_digest, lambda t: F.substring(F.hex(F.crc32(t.cast("binary"))), 1, 1), lambda t: F.substring(F.sha2(t, 256), 1, 0)]


@pytest.mark.parametrize("digest", DIGESTS)
def test_classes_are_those_of_the_bytes(spark, texts, digest):
    got = {place(r): r for r in X.exact_groups(spark, texts, "doc_id", "text", digest, batch_files=2).collect()}
    want = classes(spark, texts)
    assert len(got) == sum(map(len, want.values()))
    for text, members in want.items():
        rows = [got[p] for p in members]
        best = max((i for i in members.values() if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(best, len(members))}
        assert [r.doc_id for r in rows if r.kept] == [best]
        if digest is X.sha256_digest:
            assert {r.digest for r in rows} == {hashlib.sha256(text.encode()).hexdigest()}


def test_a_stream_goes_on_where_it_stopped(spark, texts, tmp_path):
    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    spark.createDataFrame([(1, "Same"), (2, "other")], "doc_id long, text string").coalesce(1).write.parquet(path)
    X.ingest(spark, path, state, "doc_id", "text")
    first = {r.digest: r for r in X.retained(spark, state).collect()}
    spark.createDataFrame([(9, "sAME"), (3, None)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    X.ingest(spark, path, state, "doc_id", "text")
    second = {r.digest: r for r in X.retained(spark, state).collect()}
    same = hashlib.sha256(b"same").hexdigest()
    assert (first[same].n, first[same].keep.id, second[same].n, second[same].keep.id) == (1, 1, 2, 9)
    assert len(first) == 2 and len(second) == 3
    rows = X.exact_groups(spark, path, "doc_id", "text", checkpoint=state).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == [(1, 9, 2, False), (2, 2, 1, True), (3, 3, 1, True), (9, 9, 2, True)]


def test_a_table_without_rows(spark, texts, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.read.parquet(texts).limit(0).coalesce(1).write.parquet(path)
    assert X.exact_groups(spark, path, "doc_id", "text").count() == 0


def trie_by_hand(seqs):
    nodes, kids, size = defaultdict(list), defaultdict(set), {}
    for c, t in seqs.items():
        for d in range(len(t) + 1):
            k = tuple(x for x, _ in t[:d])
            nodes[k].append(c)
            if d:
                kids[k[:-1]].add(k)
                size[k] = t[d - 1][1]
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(nodes[k]) - 1) * size[k] if k else 0)
    for k, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        up = min(nodes[k[:-1]]) if k else None
        out.append((min(m), len(k), up, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,n,length,letters,block", [(1, 60, 12, 2, 12), (2, 40, 40, 1, 1)])
def test_trie_nodes(spark, monkeypatch, seed, n, length, letters, block):
    """Branches, prefixes of each other, ties of whole sequences and empty ones, in three batches; also with blocks of two turns and ids."""
    monkeypatch.setattr(Z, "BLOCK", block)
    rng = random.Random(seed)
    bases = [[f"t{rng.randrange(letters)}" for _ in range(length)] for _ in range(3)]
    seqs = {-5: [], 7: []}
    for c in range(n):
        t = rng.choice(bases)[: rng.randrange(length + 1)] + [f"t{rng.randrange(letters)}" for _ in range(rng.randrange(4))]
        seqs[c * 997 - 300 if c % 2 else c] = [(x, 2 + int(x[1:])) for x in t]
    rows = [(c, d + 1, x, b) for c, t in seqs.items() for d, (x, b) in enumerate(t)]
    turns = spark.createDataFrame(rows, "c long, d long, token string, bytes long")
    ids = spark.createDataFrame([(c,) for c in seqs], "c long")
    got = sorted((tuple(r) for r in Z.trie_nodes(turns, ids, (0.3, 0.7, 1.0)).collect()), key=str)
    assert got == trie_by_hand(seqs)
    if block == 12:
        assert Z.trie_nodes(turns.limit(0), ids.limit(0)).count() == 0
        assert [tuple(r)[:7] for r in Z.trie_nodes(turns.limit(0), ids.filter("c < 0 AND c > -9")).collect()] == [(-5, 0, None, 1, 0, 1, 0)]


def test_two_fattest_numbers(spark):
    rows = spark.range(40).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(41).cast("long"))).alias("b"))
    for r in rows.select("a", "b", Z.two_fattest(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda i: i & -i)


def test_conversations_on_odd_rows(spark, tmp_path):
    rows = [(0, 1, "u", "hi"), (0, None, "u", "first"), (0, 1, "u", "hi"), (0, 1, "a", "hi"), (1, 0, None, None), (1, 1, "", ""), (3, 0, "u", "é" * 9), (12, 5, "u", "own"), (None, 0, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("c", "d", "total", "token", "position", "bytes", "part", "at")})
    ordered = sorted((r.c, r.position, r.total, r.token, r.bytes) for r in Z.ordered_turns(df, "conv_id", "turn", "role", "text").collect())
    token = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    last = sorted([token("u", "hi")] * 2 + [token("a", "hi")])
    assert [(c, p, k) for c, p, _, k, _ in ordered if c == 0] == [(0, 1, token("u", "first")), *[(0, i + 2, k) for i, k in enumerate(last)]]
    assert [b for c, *_, b in ordered if c == 3] == [18] and all(c is not None for c, *_ in ordered)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    original = {c: [(k, b) for o, _, _, k, b in ordered if o == c] for c in (0, 1, 3, 12)}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = original.get(c - c % 5, [])[:h] + own[h:]
    got = sorted((tuple(r) for r in Z.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == trie_by_hand(rebuilt)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof_by_hand(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i & 1 == 1))
        i >>= 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 64, None: 65, "b": 1, "é": 130}, {"a": 4097, "b": 3}])
def test_merkle_roots_and_proofs(spark, sizes):
    """Full, partial and lone runs over one to three stored levels; a repeated row, ties of the order and NULLs."""
    rows = [(None if i == 0 else i // 2, g, None if i % 5 == 0 else f"x{i // 2}{g}") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, g string, v string").withColumns({c: F.lit(1) for c in ("h", "at", "n", "o", "path", "root", "of")})
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {g: sorted(((k is not None, k or 0, sha(enc(k), enc(h), enc(v))) for k, h, v in rows if h == g)) for g in sizes}
    trees = {g: tree_by_hand([h for *_, h in m]) for g, m in groups.items()}
    order = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    top = tree_by_hand([trees[g][-1][0] for g in order])
    want = []
    for g, m in groups.items():
        for i, (there, k, h) in enumerate(m):
            path = proof_by_hand(trees[g], i) + proof_by_hand(top, order.index(g))
            want.append((g, k if there else None, h, trees[g][-1][0], top[-1][0], tuple(path), h, top[-1][0]))
    out = M.manifest(df, ["k", "g", "v"], "k", "g")
    got = [(r.g, r.k, r.leaf, r.subroot, r.root, tuple((s.sibling, s.right) for s in r.path), r.other_leaf, r.folded_root) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tampered_rows_do_not_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, "g", "t" * i) for i in range(70)], "k long, g string, v string")
    rows = M.manifest(df, ["k", "g", "v"], "k", "g", {"v": F.when(F.col("k") == 7, F.lit("other")).otherwise(F.col("v"))}).collect()
    assert {r.k for r in rows if r.folded_root != r.root} == {7} and len({r.root for r in rows}) == 1
    assert M.manifest(df.limit(0), ["k", "g", "v"], "k", "g").count() == 0
