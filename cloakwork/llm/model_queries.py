"""Queries with language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import language_model
from cloakwork.llm.document_queries import fold
from cloakwork.llm.registry import query, table


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a bigram model; one fold in ten is not learned from, one fits the mixture weights."""
    docs = table(spark, folder, "documents")
    scores = language_model.score(docs, train=fold(10) != 0, deleted=fold(10) == 1)
    return scores.select(
        "doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
