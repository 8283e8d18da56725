"""Connected components by alternating star steps; every step is a join or an aggregate, and lineage is cut in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import cut


def _hooked(edges: DataFrame) -> DataFrame:
    """(node, least): the least neighbour of each node, or itself; partly aggregated before the shuffle, then stored.

    Stored, because a join of two shuffles can be split where one node has very many edges.
    """
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def _as_edges(pairs: DataFrame) -> DataFrame:
    """Each pair once, the larger node first, none from a node to itself."""
    return pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the least node of its component.

    Large-star links every larger neighbour to the least one, small-star the smaller neighbours; both keep components and end
    in stars, after a number of rounds that grows with the logarithm of the nodes. Nodes may have any type with an order.
    Edges with a null end are left out; no edges give no rows.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    now, before = cut(_as_edges(pairs)), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_hooked(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(_as_edges(large))
        least = _hooked(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_as_edges(small.unionByName(least.withColumnRenamed("m", "v"))))
