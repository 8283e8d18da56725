"""Queries that judge documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import license_scan, line_dedup, quality_rules, spelling, toxicity
from cloakwork.llm.registry import query, table


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document, by the decision list learned from the quality labels."""
    docs = table(spark, folder, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, folder, "labels"))
    judged = quality_rules.judge(docs, rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id", *[F.col(f"_counts.{c}").alias(c) for c in counts], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept")
    )


@query("op3_license_scan", license_scan.brute_force_sql())
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence wordings in every document."""
    found = license_scan.scan(table(spark, folder, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    names = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def fold(folds: int, id_column: str = "doc_id"):
    """Fold of a row by the checksum of its id as text."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; labels of one fold in five are not learned from."""
    docs = table(spark, folder, "documents")
    judge = toxicity.learn(docs, table(spark, folder, "labels").where(fold(5) != 0))
    return toxicity.score(docs, judge).select(
        "doc_id", (fold(5) == 0).alias("held_out"), F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("_toxicity.evidence").alias("evidence"),
    )


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all texts, some damaged by rule, with their more frequent forms one edit away."""
    return spelling.spelling_variants(table(spark, folder, "documents"), least_chars=5, least_count=3, damage=97)


@query("op13_line_dedup", line_dedup.brute_force_sql())
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every text without the lines that five documents or more share, as a digest."""
    left = line_dedup.drop_shared_lines(table(spark, folder, "documents"), least_chars=40, least_docs=5)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
