"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule. A policy is a versioned set of rules, so applying one is a bitwise AND with its mask, and what a
rule adds to a policy is a sum over bits; no text is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelweave.llm.base import SPACE, let, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur at least twice in the text, each word counted once.

    Windows are sorted by hash inside the row, so equal ones are neighbours; nothing is shuffled.
    """
    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("k"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])
        return F.array_sort(F.array_compact(F.transform(s, lambda x, j: F.when(same(x, j), x["i"]))))

    def covered(p: Column) -> Column:
        to_next = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(to_next, F.lit(0), lambda a, b: a + b)

    def of(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(F.array_sort(windows(h)), lambda s: let(repeated(s), covered)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measure(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, measurements): a NULL text is measured as an empty one; one row per input row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = let(
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))
    )
    rows = docs.select(
        F.col(doc_id).alias("id"),
        t.alias("t"),
        let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"),
        lines.alias("l"),
    )
    return rows.select(
        F.col("id").alias(doc_id),
        F.col("w.n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("l.n").cast("long").alias("n_lines"),
        (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
    )


def default_rules() -> dict[str, Column]:
    """Failures over the measurements; the order gives each rule its bit."""
    words = F.col("n_words")
    return {
        "few_words": words < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * words,
        "many_symbols": 10 * F.col("n_symbols") > 4 * words,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * words,
        "long_words": F.col("word_chars") > 20 * words,
        "very_long": words > 1_000_000,
    }


POLICIES = {
    "base-1": ["few_words", "repeated_windows"],
    "full-1": ["few_words", "repeated_windows", "many_symbols", "repeated_lines"],
    "full-2": ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"],
}


def ledger(measured: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The measurements with ``failed``: bit i is set where rule i fails. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger word holds 63 rules")
    failed = F.lit(0).cast("long")
    for bit, fails in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(fails, F.lit(1 << bit)).otherwise(0).cast("long"))
    return measured.withColumn("failed", failed)


def policy_mask(rules: dict[str, Column], policy: list[str]) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in set(policy))


def passes(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask)) == 0


def ablation(ledger_rows: DataFrame, rules: dict[str, Column], policies: dict[str, list[str]]) -> DataFrame:
    """(policy, rule, n_rows, n_failed, n_rejected, n_only): documents that fail the rule, that the policy rejects, and that it rejects by
    this rule alone (which dropping the rule would keep). One pass; an empty ledger gives zeros.
    """
    names = list(rules)
    wanted = [(p, r, 1 << names.index(r), policy_mask(rules, policies[p])) for p in policies for r in policies[p]]
    failed = F.col("failed")
    cells = [
        F.struct(
            F.lit(p).alias("policy"),
            F.lit(r).alias("rule"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            F.count_if(failed.bitwiseAND(F.lit(mask)) != 0).alias("n_rejected"),
            F.count_if(failed.bitwiseAND(F.lit(mask)) == bit).alias("n_only"),
        )
        for p, r, bit, mask in wanted
    ]
    return ledger_rows.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    rules = default_rules()
    rows = ledger(measure(table(spark, sf_dir, "documents"), "doc_id", "text"), rules)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(policy_mask(rules, POLICIES["base-1"]))).alias("base_failed"),
        passes(policy_mask(rules, POLICIES["full-2"])).alias("kept"),
        F.col("failed").alias("failed_rules"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > 4 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END) AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed,
       (failed_rules & 63) = 0 AS kept, failed_rules FROM f
"""
