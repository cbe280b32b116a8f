"""LM scoring by partial matching (PPM): a byte-context trie with escapes and symbol exclusion.

The trie is a table with a row per (order, context, symbol). Each context has at most 256
symbols, so its sums are windows over bounded groups. The probability of a symbol depends on
its context alone, so each distinct gram gets it once, by one join per order:

* at a context seen n times with q symbols, a symbol seen c times has (2c-1)/2n and an escape
  q/2n (method D);
* after an escape the symbols of the longer context are excluded from the counts of the
  shorter one. Every occurrence of the longer context is one of the shorter, so what is excluded
  at an order is exactly the symbol set of the context one order up;
* below order 0 the symbols not seen at all share what is left evenly.

Two passes read the texts, both on Arrow batches. The first counts grams and words; the second
looks up the most frequent ones in a broadcast of bounded size and hands all others to a
shuffle join. No gram or word is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelweave.llm.base import Tally, byte_grams, fold, frequent, slices, table, word_codes
from panelweave.session import stage

START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
END_WORD = " "  # no word has a space
GRAM_LIMIT, WORD_LIMIT = 1 << 20, 1 << 16


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def _count(order: int):
    schema = pa.schema([("gram", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("n_train", pa.int64())])

    def run(batches):
        grams, words = Tally("gram"), Tally("word", 300_000)

        def shaped(parts):
            for b in parts:
                have = {c: b.column(c) for c in b.schema.names}
                yield pa.RecordBatch.from_arrays(
                    [have.get(f.name, pa.nulls(len(b), f.type)).cast(f.type) for f in schema], schema=schema
                )

        for batch in batches:
            train_all = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            for at, part in slices(batch.column("text")):
                train = train_all[at : at + len(part)]
                row, gram = byte_grams(_lowered(part), order, START, END)
                keys, n = np.unique(gram << 1 | train[row], return_counts=True)
                yield from shaped(grams.add(pa.table({"gram": keys >> 1, "n": n, "n_train": n * (keys & 1)})))
                row, code, dictionary = word_codes(part)
                n = np.bincount(code, minlength=len(dictionary))
                learned = np.bincount(code, train[row], len(dictionary)).astype(np.int64)
                ends = [len(part)], [int(train.sum())]
                yield from shaped(words.add(pa.table({
                    "word": pa.concat_arrays([dictionary, pa.array([END_WORD])]),
                    "n": np.append(n, ends[0]), "n_train": np.append(learned, ends[1]),
                })))
        yield from shaped(grams.take())
        yield from shaped(words.take())

    return run


def trie(grams: DataFrame, order: int) -> DataFrame:
    """(level, gram, n, big, q): counts of every suffix of the grams, with the sum and the number of symbols of its context."""
    levels = F.explode(F.array(*[
        F.struct(F.lit(j).alias("level"), F.col("gram").bitwiseAND(F.lit((1 << (8 * (j + 1))) - 1)).alias("g")) for j in range(order + 1)
    ]))
    nodes = grams.select(levels.alias("l"), "n").groupBy("l.level", "l.g").agg(F.sum("n").alias("n"))
    context = W.partitionBy("level", F.shiftright("g", 8))
    return nodes.select(
        "level", "g", "n", F.sum("n").over(context).alias("big"), F.sum((F.col("n") > 0).cast("int")).over(context).alias("q")
    )


def gram_log_probabilities(nodes: DataFrame, order: int) -> DataFrame:
    """(gram, lp): log10 probability of the last byte of each gram after the bytes before it."""
    def level(j: int) -> DataFrame:
        return nodes.filter(F.col("level") == j).drop("level")

    def own(c: Column, n: Column) -> Column:
        return F.try_divide(2 * c - 1, 2 * n)

    # rest: probability of the symbol once the context itself has escaped
    here = level(0).withColumn("rest", F.lit(1.0) / F.greatest(F.lit(1), 256 - F.col("q")))
    for j in range(1, order + 1):
        below = here.select(
            F.col("g").alias("s"), F.col("n").alias("c"), F.col("big").alias("big_below"), F.col("q").alias("q_below"), F.col("rest").alias("rest_below")
        )
        suffix = F.col("g").bitwiseAND(F.lit((1 << (8 * j)) - 1))
        joined = level(j).withColumn("s", suffix).join(below, "s")
        context = W.partitionBy(F.shiftright("g", 8))
        excluded = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("c"))).over(context), F.lit(0))
        left, kinds = F.col("big_below") - excluded, F.col("q_below") - F.col("q")
        rest = (
            F.when(left <= 0, F.col("rest_below"))
            .when(F.col("c") > 0, own(F.col("c"), left))
            .otherwise(F.try_divide(kinds, 2 * left) * F.col("rest_below"))
        )
        here = joined.select("g", "n", "big", "q", rest.alias("rest"))
    p = (
        F.when(F.col("big") <= 0, F.col("rest"))
        .when(F.col("n") > 0, own(F.col("n"), F.col("big")))
        .otherwise(F.try_divide(F.col("q"), 2 * F.col("big")) * F.col("rest"))
    )
    return here.select(F.col("g").alias("gram"), F.log10(p).alias("lp"))


def _score(order: int, shared, id_type: pa.DataType):
    def run(batches):
        grams, lps, words, word_lps, word_known = shared.value
        words = pa.array(words, pa.string())
        lps = np.append(lps, 0.0)
        task, rows = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at, part in slices(batch.column("text")):
                n_rows = len(part)
                ids = np.arange(task + rows, task + rows + n_rows)
                rows += n_rows
                row, gram = byte_grams(_lowered(part), order, START, END)
                keys, inverse = np.unique(gram, return_inverse=True)
                found = np.searchsorted(grams, keys)
                hit = found < len(grams)
                hit[hit] = grams[found[hit]] == keys[hit]
                found[~hit] = len(lps) - 1
                score = np.bincount(row, lps[found][inverse], n_rows)
                rare = ~hit[inverse]
                rare_row, rare_gram = row[rare], keys[inverse[rare]]
                both = np.lexsort((rare_gram, rare_row))
                rare_row, rare_gram = rare_row[both], rare_gram[both]
                new = np.ones(len(both), dtype=bool)
                new[1:] = (rare_row[1:] != rare_row[:-1]) | (rare_gram[1:] != rare_gram[:-1])
                first = np.flatnonzero(new)
                gram_n = np.diff(np.append(first, len(both)))

                row, code, dictionary = word_codes(part)
                place = pc.fill_null(pc.index_in(dictionary, words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                spot = place[code]
                base = np.bincount(row, np.append(word_lps, 0.0)[spot], n_rows)
                known = np.bincount(row, np.append(word_known, 0)[spot], n_rows)
                lost = spot < 0
                pairs, word_n = np.unique(row[lost] * max(1, len(dictionary)) + code[lost], return_counts=True)
                word_row, word_code = np.divmod(pairs, max(1, len(dictionary)))

                def out(count, **have):
                    types = {"row": pa.int64(), "id": id_type, "held_out": pa.bool_(), "n_words": pa.int64(), "n_known": pa.int64(),
                             "base": pa.float64(), "ppm": pa.float64(), "gram": pa.int64(), "word": pa.string(), "n": pa.int64()}
                    return pa.RecordBatch.from_arrays(
                        [(have[c] if isinstance(have.get(c), pa.Array) else pa.array(have[c])).cast(t) if c in have else pa.nulls(count, t) for c, t in types.items()],
                        names=list(types),
                    )

                yield out(
                    n_rows, row=ids, id=batch.column("id").slice(at, n_rows), held_out=pc.invert(batch.column("train").slice(at, n_rows)),
                    n_words=np.bincount(row, minlength=n_rows), n_known=known.astype(np.int64), base=base, ppm=score,
                )
                yield out(len(first), row=ids[rare_row[first]], gram=rare_gram[first], n=gram_n)
                yield out(len(pairs), row=ids[word_row], word=dictionary.take(pa.array(word_code)), n=word_n)

    return run


def score_documents(docs: DataFrame, doc_id: str, text: str, train: Column, order: int = 5) -> DataFrame:
    """Score every row by a trie of the rows where ``train`` holds.

    Returns doc_id, held_out (not train), n_tokens, n_known, train_tokens, base_score and score (log10 of
    the word model's and the trie's probability). One row per input row; repeated rows and ids each get their own. A NULL
    or empty text has the end symbol only. NULL in ``train`` counts as false. An empty table gives no
    rows. With nothing to learn from, symbols share evenly and base_score is 0. Other columns are ignored.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6: a gram must fit 7 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.select("text", "train").mapInArrow(_count(order), "gram long, word string, n long, n_train long")
    counts = stage(counted.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train")), "counts")
    words = counts.filter(F.col("word").isNotNull())
    grams = counts.filter(F.col("gram").isNotNull()).select("gram", F.col("n").alias("n_all"), F.col("n_train").alias("n"))

    nodes = stage(trie(grams, order), "trie")
    model = stage(gram_log_probabilities(nodes, order).join(grams.select("gram", "n_all"), "gram"), "grams")

    total = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n_train") > 0).cast("long")), F.lit(0)).alias("v")).first()
    whole = total["n"] + 0.5 * (total["v"] + 1)
    lexicon = words.select("word", "n", F.log10((F.col("n_train") + 0.5) / whole).alias("lp"), (F.col("n_train") > 0).cast("long").alias("known"))
    end = lexicon.filter(F.col("word") == END_WORD).first()
    end_lp, end_known = (end["lp"], end["known"]) if end else (0.0, 0)

    top_grams = frequent(model, "n_all", GRAM_LIMIT).select("gram", "lp").toArrow().sort_by("gram")
    top_words = frequent(lexicon, "n", WORD_LIMIT).select("word", "lp", "known").toArrow()
    shared = spark.sparkContext.broadcast((
        top_grams["gram"].to_numpy(), top_grams["lp"].to_numpy(),
        top_words["word"].to_pylist(), top_words["lp"].to_numpy(), top_words["known"].to_numpy(),
    ))
    del top_grams, top_words
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["id"].dataType
    schema = f"row long, id {id_type.simpleString()}, held_out boolean, n_words long, n_known long, base double, ppm double, gram long, word string, n long"
    parts = stage(rows.mapInArrow(_score(order, shared, to_arrow_type(id_type)), schema), "scores")

    sums = ["n_known", "base", "ppm"]
    own = parts.filter(F.col("n_words").isNotNull()).select("row", F.struct("id", "held_out", "n_words").alias("doc"), *sums)
    rare_grams = parts.filter(F.col("gram").isNotNull()).select("row", "gram", "n").join(model.select("gram", "lp"), "gram")
    rare_words = parts.filter(F.col("word").isNotNull()).select("row", "word", "n").join(lexicon.select("word", "lp", "known"), "word")
    zero, no_doc = F.lit(0.0), F.lit(None).cast(own.schema["doc"].dataType).alias("doc")
    pieces = [
        own,
        rare_grams.select("row", no_doc, F.lit(0).cast("long").alias("n_known"), zero.alias("base"), (F.col("n") * F.col("lp")).alias("ppm")),
        rare_words.select("row", no_doc, (F.col("n") * F.col("known")).alias("n_known"), (F.col("n") * F.col("lp")).alias("base"), zero.alias("ppm")),
    ]
    whole_rows = reduce(DataFrame.unionByName, pieces).groupBy("row").agg(F.max("doc").alias("doc"), *[F.sum(c).alias(c) for c in sums])
    return whole_rows.select(
        F.col("doc.id").alias(doc_id),
        F.col("doc.held_out").alias("held_out"),
        (F.col("doc.n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + end_known).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + end_lp).alias("base_score"),
        F.col("ppm").alias("score"),
    )


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, "doc_id", "text", fold(F.col("doc_id"), 5) != 1)
