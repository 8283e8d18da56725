"""A training corpus out of documents: quality, toxicity, near duplicates, packing."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import stages
from cloakwork.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.keep_good),
    ("toxicity", stages.keep_civil),
    ("jaccard_join", stages.keep_one_of_near_copies),
    ("packing", stages.pack_rest),
]

ORACLE_SQL: str | None = None  # learned rules, neighbour votes and packing have no SQL counterpart


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
