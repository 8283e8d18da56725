"""Queries on near copies and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import bit_planes, embedding_dedup, jaccard_join
from cloakwork.llm.registry import query, table


@query("op2_embedding_dedup")
def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of embeddings with cosine 0.95 or more."""
    return embedding_dedup.link_embeddings(table(spark, folder, "embeddings"), least=0.95)


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.link(table(spark, folder, "documents"), size=4, percent=85)


@query("op12_centroid_clusters", bit_planes.brute_force_sql())
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in sixteen clusters after three rounds."""
    return bit_planes.cluster_vectors(table(spark, folder, "embeddings"), clusters=16, rounds=3, scale=64, seed="1")
