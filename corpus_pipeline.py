"""A corpus pipeline: language ID, near copies, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``docs``.
``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm.base import free_name, table
from panelweave.llm.decontaminate import decontaminate
from panelweave.llm.lang_id import learn_languages, vote
from panelweave.llm.mixing import mix_sources
from panelweave.llm.secrets import redact
from panelweave.llm.simhash import drop_simhash_copies
from panelweave.session import drop_stages, stage, stage_mark

LEAST_OWN = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those of whose n-grams no learned language contains ``LEAST_OWN``, chance hits taken off.

    The share is the winner's own, so it does not fall as languages are added. NULL and empty texts go; repeated rows stay or go
    together. Columns stay as they are, whatever their names. An empty table, or one without a known language, gives no rows.
    """
    voted = vote(docs, "text", learn_languages(docs, "text", "lang"))
    return docs.filter((voted["pred"] != "und") & (voted["own"] >= LEAST_OWN))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash near-dedup links (three-word shingles, 2 bits): the one with the least id, NULL last.

    NULL is an empty text; empty texts are copies of each other. Columns of any name stay, an empty table gives no rows.
    """
    return drop_simhash_copies(docs, "doc_id", "text")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; NULL texts stay, without items all do."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; the length follows, and is NULL for a NULL text. One row per row."""
    return redact(docs, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their size and the words taken; documents not taken are left out, so are texts without a word.

    Columns of these names that the documents have already keep their names; the new ones get underscores before theirs. A NULL
    source is a source. An empty table gives no rows.
    """
    mixed, _ = mix_sources(docs, "doc_id", "text", "source")
    new = [F.col(f"mix.{c}").alias(free_name(docs, c)) for c in ("size", "taken")]
    return mixed.filter("mix.taken > 0").select("row.*", *new)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_copies),
    ("decontaminate", leaks),
    ("secrets", secrets),
    ("mix", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What a stage wrote on its way goes once its result, which the next one reads, is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        mark = stage_mark(spark)
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stages(spark, mark, keep_last=True)
    return docs
