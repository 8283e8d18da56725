"""Stages of the corpus pipeline: each works on all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import jaccard_join, packing, quality_rules, toxicity
from cloakwork.llm.registry import ship, table
from cloakwork.llm.token_queries import BYTE_BPE

SLICE_BYTES = 1 << 20  # of text that packing encodes at once: executors still hold what the stages before left them


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], test: str) -> DataFrame:
    """Whole rows of ``docs`` that pass; the judge sees id and text only, so no column of the documents clashes with its own."""
    bare = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole_row"))
    return judge(bare).where(test).select("_whole_row.*")


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule and the learned decision list accept.

    Null and empty texts fail the base rule; repeated rows are judged alike and all stay or go; null ids are judged by their text
    but teach nothing; an empty table gives no rows; other columns stay as they are, whatever their names.
    """
    ship(spark)
    rules = quality_rules.learn_rules(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    return judged(docs, lambda rows: quality_rules.judge(rows, rules), "_kept")


def keep_civil(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below one half.

    Null and empty texts get the score of a text that is like no example; repeated rows score alike; null ids teach nothing; an
    empty table gives no rows; other columns stay as they are, whatever their names.
    """
    ship(spark)
    judge = toxicity.learn(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    return judged(docs, lambda rows: toxicity.score(rows, judge), "_toxicity.score < 0.5")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document with the least id.

    Rows are told apart by id and a 64-bit hash of the text, so a text under an id that others have too is judged by itself; of
    rows that repeat both, one stays. Null and empty texts link with nothing and stay. Rows without an id cannot be named by a
    component: they all stay. An empty table gives no rows; other columns stay as they are, whatever their names.
    """
    ship(spark)
    mark = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("doc"), mark.alias("mark")))
    rows = docs.select(key.alias("key"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    linked = jaccard_join.link(rows.select("key", "text"), size=5, percent=80, id_column="key")
    chosen = linked.where("key = component_id").select("key").distinct()
    once = rows.where("key IS NOT NULL").join(chosen, "key", "left_semi").dropDuplicates(["key"])
    return once.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def pack_rest(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of at most 1024 tokens.

    Null and empty texts are one end token; repeated rows and null ids are packed like others; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    ship(spark)
    return packing.pack(docs, BYTE_BPE, max_tokens=1024, slice_bytes=SLICE_BYTES)
