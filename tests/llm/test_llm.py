"""The operators of panelweave.llm against brute force, SQL, and tables of odd rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from panelweave.llm import (
    decontaminate as D, lang_id as L, lm_score as P, mixing as M, quality_class as C, quality_rules as R, secrets as S,
    sentences as N, simhash as H, url_templates as U,
)
from panelweave.llm.components import components
from panelweave.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

ODD = [
    (1, "The cat sat on the mat. The dog ran off. It was late in the day and all was quiet. Good night to all of you.", "en", "a"),
    (1, "The cat sat on the mat. The dog ran off. It was late in the day and all was quiet. Good night to all of you.", "en", "a"),
    (2, None, None, None), (3, "", "de", "b"), (None, " \n\t ", None, "b"), (None, "über token = 'abcdef123456' ñandú", "es", None),
    (4, "word " * 30_000, "en", "a"), (5, "!!! ???", "fr", "c"), (2, "one", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns(
        {c: F.lit(7) for c in ("id", "key", "row", "size", "h", "n", "fp", "t", "spans", "_digest", "block", "pattern")}).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    assert [p for p in compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) if p != "no rows"] == []


def brute_ppm(texts, train, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    streams = [bytes([P.START]) * order + t.encode().lower() + bytes([P.END]) for t in texts]
    for s, learn in zip(streams, train):
        for i in range(order, len(s)):
            for k in range(order + 1):
                if learn:
                    counts[k][s[i - k : i]][s[i]] += 1
    out = []
    for s in streams:
        total = 0.0
        for i in range(order, len(s)):
            p, excluded = 1.0, set()
            for k in range(order, -1, -1):
                seen = counts[k][s[i - k : i]]
                left = {c: n for c, n in seen.items() if c not in excluded}
                n = sum(left.values())
                if n:
                    if s[i] in left:
                        p *= (2 * left[s[i]] - 1) / (2 * n)
                        break
                    p *= len(left) / (2 * n)
                excluded |= set(seen)
            else:
                p /= 256 - len(excluded)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 16), (8, 2)])
def test_lm_score_is_the_textbook_model(spark, monkeypatch, limits):
    monkeypatch.setattr(P, "GRAM_LIMIT", limits[0])
    monkeypatch.setattr(P, "WORD_LIMIT", limits[1])
    texts = ["Banana band", "bandana BAN", "", "zebra é ñ", "band band band " * 3]
    train = [True, True, True, False, True]
    df = spark.createDataFrame(list(zip(range(5), texts, train)), "doc_id long, text string, train boolean")
    rows = sorted(P.score_documents(df, "doc_id", "text", F.col("train"), 3).collect(), key=lambda r: r.doc_id)
    assert [r.score for r in rows] == pytest.approx(brute_ppm(texts, train, 3))
    words = Counter(w for t, x in zip(texts, train) if x for w in [*t.lower().split(), None])
    whole = sum(words.values()) + 0.5 * (len(words) + 1)
    for r, t in zip(rows, texts):
        tokens = [*t.lower().split(), None]
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / whole) for w in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in words for w in tokens), sum(words.values()))


def test_mix_meets_its_targets(spark, sf):
    rows = QUERIES["op2_mix_sources"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op2_mix_sources"](spark, sf).collect()))
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 1 for (_, t), n in by.items())


def test_flow_moves_words_between_overlapping_sources():
    flow = M.route({("a",): 5, ("a", "b"): 10, ("b", "c"): 4}, {"a": 12, "b": 3, "c": 4})
    taken = {s: sum(f.get(s, 0) for f in flow.values()) for s in "abc"}
    assert taken == {"a": 12, "b": 3, "c": 4}
    assert sum(max(0, sum(f.values()) - c) for f, c in zip(flow.values(), (5, 10, 4))) == 0


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, sf).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_url_rules(spark, sf):
    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    for r in QUERIES["op6_url_templates"](spark, sf).collect():
        want = rule(r.host, r.path)
        assert r.rule == (want[0] if want else None) and r.verdict in ("allow", "block")
        assert want is None or r.verdict == want[1]
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://A.Net"), (4, "x://A.NET/en/1?q#f"), (4, "x://A.NET/en/1?q#f")]
    out = U.judge_urls(spark.createDataFrame(urls, "page_id long, url string").withColumn("path", F.lit(1)), "page_id", "url").collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in out if r.page_id > 2) == [(3, "a.net", "", None), (4, "a.net", "/en/1", "net/"), (4, "a.net", "/en/1", "net/")]
    assert sorted((r.page_id, r.host, r.path) for r in out if r.page_id < 3) == [(1, "", ""), (2, "", "")]


def test_urls_without_evidence_are_allowed(spark):
    urls = [f"http://a.net/p{i}/x" for i in range(30)]  # blocked labels outnumber all others
    urls += [f"http://example.com/de/{i}" for i in range(20)]
    free = ["http://example.com/", "http://example.com/en/a", "http://example.com/en/1", "http://plain.test/", "http://plain.test/de/1", "none"]
    df = spark.createDataFrame(list(enumerate(urls + free)), "page_id long, url string")
    out = {r.page_id: r for r in U.judge_urls(df, "page_id", "url").collect()}
    assert all(out[i].verdict == "block" and out[i].rule for i in range(50))
    assert all(out[50 + i].verdict == "allow" and out[50 + i].rule is None and out[50 + i].purity == 0.5 for i in range(len(free)))
    # labels of its own decide a template: those of ruled urls hold for an unruled one of the same template, other branches' do not
    rules = [("h", f"/user/name{i}/", "block") for i in range(14)] + [("h", "/shop/", "allow")]
    urls = [f"http://h/user/name{i}/x" for i in range(40)] + ["http://h/shop/x", "http://h/other/x"]
    out = [r.verdict for r in sorted(U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id", "url", rules).collect(), key=lambda r: r.page_id)]
    assert out == ["block"] * 40 + ["allow", "allow"]


def test_variable_segments_become_wildcards(spark):
    paths = spark.createDataFrame([("h", f"/user/name{i}/x", 1) for i in range(40)], "host string, path string, n long")
    assert {tuple(r.template) for r in U.template_tree(paths).collect()} == {("user", "*", "x")}


def test_repeated_passages_of_any_number_of_sentences(spark):
    long = " ".join(f"w{i}" for i in range(60))
    lines = "".join(f"a{i} b{i} c{i}\n" for i in range(20))  # 60 words, three a line
    two = " ".join(f"x{i}" for i in range(30)) + ". " + " ".join(f"y{i}" for i in range(25)) + "."
    tail = "".join(" ".join(f"t{k}n{i}" for i in range(n)) + "\n" for k, n in enumerate((30, 5, 30, 4)))
    blocks = [long + ".\n", lines, two + "\n", tail]
    docs = [(10 * k + d, f"Own start {k} {d}.\n{b}own end {k} {d}.") for k, b in enumerate(blocks) for d in (1, 2)]
    docs += [(91, "Just this one."), (92, "just  THIS one."), (93, "Just this one. And more."), (94, "a\nb\nc"), (95, "a\nb\nc"), (96, None), (97, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in N.drop_repeated_spans(df, "doc_id", "text", passage_words=50).collect()}
    for k in range(len(blocks)):
        assert texts[10 * k + 1] == docs[2 * k][1]
        assert texts[10 * k + 2].split() == f"Own start {k} 2. own end {k} 2.".split()
    assert [texts[i] for i in range(91, 98)] == ["Just this one.", "", "Just this one. And more.", "a\nb\nc", "", "", ""]
    # one word less than asked is not a passage
    short = [(d, f"Own {d}.\n" + " ".join(f"w{i}" for i in range(49)) + f"\nend {d}.") for d in (1, 2)]
    assert {r.n_removed for r in N.drop_repeated_spans(spark.createDataFrame(short, "doc_id long, text string"), "doc_id", "text", passage_words=50).collect()} == {0}


def test_importance_prefers_the_target(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 20) for i in range(40)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = C.importance_resample(docs, labels, "doc_id", "text", fraction=20 / 41).collect()
    assert {r.doc_id for r in rows if r.selected} == set(range(1, 40, 2))


def brute_groups(keys, linked):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def test_simhash_fingerprints_and_groups(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op10_simhash"](spark, sf).collect():
        words = (texts[r.doc_id] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = [0, 1, 3, 7, -(1 << 63), -1, -2, 0x0F0F, 0x0F0E ^ (1 << 40), 12345]
    want = brute_groups(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(H.hamming_links(df)).collect()}
    roots = [got.get(p, p) for p in prints]
    assert [[a == b for b in roots] for a in roots] == [[a == b for b in want] for a in want]


def test_near_copies_leave_one_of_each_group(spark):
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base[:i * 6] + [f"x{i}"] + base[i * 6 + 1:])) for i in range(12)]  # similar to each other at 0.84
    docs += [(100 + i, " ".join(f"u{i}v{j}" for j in range(60))) for i in range(8)] + [(200, docs[0][1]), (200, docs[0][1]), (300, None), (301, "")]
    kept = {r.doc_id for r in H.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    assert kept == {0, 300, *range(100, 108)}


def test_near_copies_in_a_family_of_drifted_texts(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(800):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 6)):
            words[k] = f"x{i}y{k}"
        texts.append(" ".join(words))
        if i % 10 == 0:  # a copy of 0.8 or more of a text in the middle of the family
            words[rng.randrange(120)] = f"z{i}"
            texts.append(" ".join(words))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    pairs = [len(a & b) for j, a in enumerate(sets) for b in sets[:j]]
    near = iter([n >= 0.8 * (len(a) + len(b) - n) for (a, b), n in zip(((a, b) for j, a in enumerate(sets) for b in sets[:j]), pairs)])
    linked = {(j, i) for j in range(len(sets)) for i in range(j) if next(near)}
    want = brute_groups(list(range(len(sets))), lambda a, b: (max(a, b), min(a, b)) in linked)
    assert 50 < len(set(want)) < len(texts) - 50
    kept = {r.doc_id for r in H.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert kept == set(want)


def test_trigram_queries():
    assert S.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert S.trigram_query("[0-9a-f]+") == [] and S.trigram_query("(ab)?cd*") == []
    assert S.trigram_query("(foo|bar)x") == [frozenset({"bar", "arx"}), frozenset({"foo", "oox"})]


def test_redaction(spark):
    df = spark.createDataFrame([(1, 'x token = "abcdef123" y'), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in S.redact(df, "doc_id", "text").collect()} == {1: 'x [SECRET]" y', 2: "plain", 3: None}


def test_ablation_counts(spark, odd):
    rules = R.default_rules()
    rows = R.ledger(R.measure(odd, "doc_id", "text"), rules)
    got = {(r.policy, r.rule): r for r in R.ablation(rows, rules, R.POLICIES).collect()}
    failed = [r.failed for r in rows.collect()]
    for (policy, rule), r in got.items():
        bit, mask = 1 << list(rules).index(rule), R.policy_mask(rules, R.POLICIES[policy])
        assert (r.n_failed, r.n_rejected, r.n_only) == tuple(map(sum, ([bool(f & bit) for f in failed], [bool(f & mask) for f in failed], [f & mask == bit for f in failed])))


APPLY = {
    "lm": lambda d: P.score_documents(d, "doc_id", "text", F.lit(True), 2),
    "mix": lambda d: M.mix_sources(d, "doc_id", "text", "source")[0],
    "language": lambda d: d.select("doc_id", *L.predict_languages(d, "text", L.learn_languages(d, "text", "lang"))),
    "spans": lambda d: N.drop_repeated_spans(d, "doc_id", "text"),
    "importance": lambda d: C.importance_resample(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")), "doc_id", "text"),
    "secrets": lambda d: S.find_secrets(d, "doc_id", "text"),
    "rules": lambda d: R.measure(d, "doc_id", "text"),
    "simhash": lambda d: H.simhash_groups(d, "doc_id", "text"),
    "urls": lambda d: U.judge_urls(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_every_row_of_an_odd_table_has_a_result(odd, name):
    assert APPLY[name](odd).count() == len(ODD)
    assert APPLY[name](odd.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "it was late in the day and all was quiet"), (2, None), (3, "one"), (3, "one")], "item_id long, text string")
    found = D.contained_items(odd, items, "doc_id", "text", "item_id", "text").collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in found) == [(1, 1, 5), (2, 3, 1)]
    left = D.decontaminate(odd, items, "doc_id", "text", "item_id", "text")
    assert left.columns == odd.columns and left.count() == len(ODD) - 3
    kept = H.drop_near_copies(odd, "doc_id", "text")
    assert kept.columns == odd.columns and kept.count() == 7
    for empty in (odd.limit(0), ):
        assert D.decontaminate(empty, items, "doc_id", "text", "item_id", "text").count() == H.drop_near_copies(empty, "doc_id", "text").count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) <= set(out.columns) and 0 < out.count() <= docs.count()
    texts = out.select("text").collect()
    assert not any("AKIA0" in r.text for r in texts)
