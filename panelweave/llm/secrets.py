"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: an OR of
ANDs that every match satisfies. The index has a posting (trigram, document key) for each trigram that
some query asks for. Postings are intersected per document as a bit mask, and the documents that
satisfy a query form a set of keys, held as a bitmap of fixed size. Verification runs a rule's expression
over the documents the bitmap lets through; a rule without mandatory trigrams scans all texts. A false
hit of the bitmap costs one more scan and changes no result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as sre, _parser as sre_parse

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import ascii_lower, let, table
from panelweave.llm.keyfilter import key_filter, may_have
from panelweave.session import stage


@dataclass(frozen=True)
class Rule:
    """A regular expression (Java), with the least length of a group; shorter matches are found and dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the kinds asked for first, then common public token formats
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    # to the END line, or over the lines of base64 where there is none
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09\x0A\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09]*[\x0A\x0D]+[A-Za-z0-9+/=]{16,})*)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ["assign", "access", "hex"]


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]]:
    """An OR of trigram sets, one of which every match's lower-cased text contains; empty: no mandatory trigram."""
    def literals(nodes) -> list[list[str]]:
        """Alternatives, each a list of texts that a match contains."""
        found, current = [[]], [""]

        def close():
            nonlocal found, current
            found = [a + [c] for a in found for c in current]
            current = [""]

        for op, arg in nodes:
            if op is sre.LITERAL:
                current = [c + chr(arg).lower() for c in current]
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) * len(current) <= most:
                current = [c + chr(v).lower() for c in current for _, v in arg]
            elif op is sre.SUBPATTERN or op is sre.BRANCH:
                branches = [arg[3]] if op is sre.SUBPATTERN else arg[1]
                inner = [a for b in branches for a in literals(b)]
                if all(len(a) == 1 for a in inner) and len(inner) * len(current) <= most and all(exact(b) for b in branches):
                    current = [c + a[0] for c in current for a in inner]
                else:
                    close()
                    found = [a + b for a in found for b in inner]
            elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and exact(arg[2]):
                current = [c + x for c in current for x in ("", *(a[0] for a in literals(arg[2])))]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                close()
                found = [a + b for a in found for b in literals(arg[2])]
            elif op is not sre.AT:
                close()
            if len(found) * len(current) > most:
                close()
                return [[]] if len(found) > most else found
        close()
        return found

    def exact(nodes) -> bool:
        return all(
            op is sre.LITERAL or (op is sre.SUBPATTERN and exact(arg[3])) or (op is sre.BRANCH and all(exact(b) for b in arg[1])) for op, arg in nodes
        )

    alternatives = literals(sre_parse.parse(pattern))
    sets = {frozenset("".join(t) for s in a for t in zip(s, s[1:], s[2:])) for a in alternatives}
    return [] if frozenset() in sets else sorted(sets, key=sorted)


def trigram_postings(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """(trigram number, key): which rows have which of the trigrams."""
    present = let(ascii_lower(F.col(text)), lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(i)) for i, g in enumerate(trigrams)])))
    return docs.select(key, F.explode(present).alias("trigram")).distinct()


def candidates(postings: DataFrame, key: str, trigrams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, a boolean per rule): rows whose postings satisfy the query of some rule. At most 63 trigrams a mask word."""
    bit = {g: i for i, g in enumerate(trigrams)}
    words = range((len(trigrams) + 62) // 63)
    masks = postings.groupBy(key).agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr(f"shiftleft(1L, trigram - {63 * w})")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words
    ])

    def holds(grams: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            need = sum(1 << (bit[g] - 63 * w) for g in grams if bit[g] // 63 == w)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need)) == need)
        return out

    hits = {}
    for kind, query in queries.items():
        any_of = F.lit(False)
        for grams in query:
            any_of = any_of | holds(grams)
        hits[kind] = any_of
    return masks.select(key, *[h.alias(k) for k, h in hits.items()])


def _matches(t: Column, rule: Rule) -> Column:
    """Start and end of each match, in code points; the gaps between matches give the positions."""
    whole = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(t, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(t, rule.pattern, -1)
    cells = F.zip_with(F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("n"), F.length(p).alias("p"))), gaps,
                       lambda m, g: F.struct(F.length(g).alias("g"), m["n"].alias("n"), m["p"].alias("p")))
    span = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["g"]
        end = begin + m["n"]
        spans = F.when(m["p"] >= rule.least, F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), spans.alias("out"))

    found = F.aggregate(F.filter(cells, lambda m: m["n"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(t.rlike(rule.pattern), found).otherwise(F.array().cast(span))


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, doc_id: str, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans: start, kind number, kind, end, in that order), one row per input row.

    Matches are leftmost and non-overlapping per kind; ends are exclusive. A NULL or empty text has no span. Rows are
    matched to postings by their text, so ids may repeat or be NULL. The row itself is carried
    along as ``row``. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ).withColumn("key", F.xxhash64("t"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted(set(itertools.chain.from_iterable(g for q in queries.values() for g in q)))
    gate = {}
    if trigrams:
        marked = candidates(trigram_postings(rows, "key", "t", trigrams), "key", trigrams, queries)
        hits = stage(marked.filter(" OR ".join(f"`{k}`" for k in queries)), "candidates")
        keys = key_filter(hits, {k: F.when(F.col(k), F.col("key")) for k in queries})
        rows, gate = may_have(rows, keys, F.col("key"), list(queries))
    found = []
    for i, rule in enumerate(rules):
        tagged = _tagged(_matches(F.col("t"), rule), i, rule.kind)
        if rule.kind in gate:
            tagged = F.when(gate[rule.kind], tagged).otherwise(F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
        found.append(tagged)
    return rows.select("id", "row", "t", F.array_sort(F.concat(*found)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, doc_id: str, text: str, mask: str = "[SECRET]", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every span of its text replaced; overlapping spans are replaced as one.

    Columns as given, whatever their names; texts without spans stay, NULL too. One row per input row; an empty table gives no rows.
    """
    found = find_secrets(docs, doc_id, text, rules)

    def step(acc: Column, s: Column) -> Column:
        clean = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(clean, piece).otherwise("")).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["at"] + 1, F.length("t"))))
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("row")[text])
    return found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _kind_sql(i: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    whole, gap = f"regexp_extract_all(t, '{pattern}', 0)", f"string_split_regex(t, '{pattern}')"
    part = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""SELECT r, {i} AS k, '{rule.kind}' AS kind, CAST(sum(g + n) OVER (PARTITION BY r ORDER BY j) - n AS BIGINT) AS s,
      CAST(sum(g + n) OVER (PARTITION BY r ORDER BY j) AS BIGINT) AS e, p FROM (
      SELECT r, generate_subscripts(w, 1) AS j, unnest(list_transform(w, lambda x: length(x))) AS n, unnest(list_transform(v, lambda x: length(x))) AS p,
        unnest(list_transform(y[1:len(w)], lambda x: length(x))) AS g
      FROM (SELECT r, {whole} AS w, {part} AS v, {gap} AS y FROM d))"""


def oracle() -> str:
    kinds = "\nUNION ALL ".join(f"SELECT r, k, kind, s, e FROM ({_kind_sql(i, r)}) WHERE p >= {r.least}" for i, r in enumerate(RULES))
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({listed} FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256, {listed}, '') AS spans
FROM d LEFT JOIN m USING (r) GROUP BY r, doc_id"""
