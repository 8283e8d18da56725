"""Queries on token ids: encoding and decoding, packing, counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import bpe, packing, token_counts
from cloakwork.llm.registry import query, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    encoded = bpe.encode(table(spark, folder, "documents"), BYTE_BPE)
    return bpe.decode(encoded, BYTE_BPE).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op8_pack_documents")
def op8_pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), BYTE_BPE, max_tokens=1024)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every text; rows with more than 2048 are marked."""
    return token_counts.count_tokens(table(spark, folder, "documents"), WORD_BPE, limit=2048)
