"""Centroid clustering of integer vectors by bit planes: one 64-bit word per plane, dot products from AND and popcount."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.batches import result_schema
from cloakwork.session import scratch_path

COMPONENTS = 64
BITS = 25  # components lie in -2^24 .. 2^24 - 1, so that every distance and sum fits a long
ROWS = 8192  # vectors handled at once in a task


def to_planes(values: np.ndarray) -> np.ndarray:
    """(rows, bits) words: bit j of word b is bit b of component j in two's complement; the last plane is the sign."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    bits = most.bit_length() + 1
    planes = np.empty((len(values), bits), "<u8")
    for b in range(bits):
        planes[:, b] = np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(bits: int) -> np.ndarray:
    """What a plane's bits stand for: powers of two, the sign's negative."""
    out = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def dots(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows with all rows of ``others``: each pair of planes is ANDed, counted and weighed."""
    out = np.zeros((len(planes), len(others)), np.int64)
    own, their = weights(planes.shape[1]), weights(others.shape[1])
    for k in range(len(others)):
        for i in range(planes.shape[1]):
            both = np.bitwise_count(planes[:, i, None] & others[k]).astype(np.int64)
            out[:, k] += own[i] * (both @ their)
    return out


def squared_lengths(planes: np.ndarray) -> np.ndarray:
    """Exact dot product of each row with itself."""
    out, own = np.zeros(len(planes), np.int64), weights(planes.shape[1])
    for i in range(planes.shape[1]):
        out += own[i] * (np.bitwise_count(planes[:, i, None] & planes).astype(np.int64) @ own)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it); of equally near ones the smallest number."""
    centres = to_planes(centroids)
    distance = squared_lengths(planes)[:, None] + squared_lengths(centres) - 2 * dots(planes, centres)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def component_sums(planes: np.ndarray, cluster: np.ndarray, clusters: int) -> np.ndarray:
    """(clusters, 64) sums of the components of each cluster's rows: set bits of each plane, counted and weighed."""
    out = np.zeros((clusters, COMPONENTS), np.int64)
    for b, weight in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in np.unique(cluster):
            out[k] += weight * bits[cluster == k].sum(axis=0, dtype=np.int64)
    return out


def _read(batch: pa.RecordBatch) -> np.ndarray:
    """Planes of a batch; rows of fewer planes are widened by their sign."""
    lists = batch.column("planes")
    words, offsets = lists.flatten().to_numpy(zero_copy_only=False).view("<u8"), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]  # a slice keeps the offsets of its whole
    wide = int(np.diff(offsets).max(initial=1))
    return words[np.minimum(offsets[:-1, None] + np.arange(wide), offsets[1:, None] - 1)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            planes = to_planes(batch.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS))
            lists = pa.ListArray.from_arrays(np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1], planes.reshape(-1).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "planes"])


def _summing(centroids: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per centroid and task: number of its rows, sums of their components."""
        clusters = len(centroids)
        count, sums = np.zeros(clusters, np.int64), np.zeros((clusters, COMPONENTS), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                planes = _read(whole.slice(start, ROWS))
                cluster, _ = nearest(planes, centroids)
                count += np.bincount(cluster, minlength=clusters)
                sums += component_sums(planes, cluster, clusters)
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(clusters, dtype=np.int32), "n": count, "sums": sums.tolist()})

    return add


def _assigning(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                cluster, distance = nearest(_read(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return assign


def cluster_vectors(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1", id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that can be clustered.

    Kept are vectors of 64 components, none null or not finite; each component x becomes the integer floor(scale * x). The
    ``clusters`` vectors with the smallest SHA-256 of ``<seed>:<id>`` are the first centroids (a null id hashes as an empty one;
    repeated ids by their components). Each round assigns every vector to the nearest centroid, the smaller number on ties, and
    replaces every centroid with vectors by floor(sum / count) of each component; after the last round vectors are assigned once
    more. Fewer vectors than clusters give fewer centroids; repeated rows are vectors of their own; no vectors give no rows;
    other columns are ignored, whatever their names. A component outside -2^24 .. 2^24 - 1 fails the job: distances would leave
    the long range.

    Vectors are packed once into planes in shared storage. A round is one pass without a shuffle of vectors: each task returns a
    row per centroid, and ``clusters`` x 64 sums, whatever the number of vectors, come to the driver.
    """
    spark = vectors.sparkSession
    folder = scratch_path(spark, "planes")
    inner = F.col("v")
    good = (F.size(inner) == COMPONENTS) & F.forall(inner, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(F.coalesce(good, F.lit(False)))
    within = lambda y: F.when((y >= -(1 << BITS - 1)) & (y < 1 << BITS - 1), y).otherwise(
        F.raise_error(F.lit("a component times the scale is outside -2^24 .. 2^24 - 1")).cast("double")
    )
    whole = F.transform(inner, lambda x: F.floor(within(F.lit(float(scale)) * x.cast("double"))).cast("long"))
    rows = rows.select("id", whole.alias("whole"))
    first = rows.select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("hash"), "whole"
    ).orderBy("hash", "whole").limit(clusters).collect()
    key = result_schema(vectors, id_column, "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return spark.createDataFrame([], key)
    centroids = np.array([r["whole"] for r in first], np.int64)
    of_id = vectors.schema[id_column].dataType.simpleString()
    rows.mapInArrow(_pack, f"id {of_id}, planes array<long>").write.parquet(os.path.join(folder, "packed"))
    packed = spark.read.parquet(os.path.join(folder, "packed"))
    for _ in range(rounds):
        told = packed.select("planes").mapInArrow(_summing(centroids), "cluster int, n long, sums array<long>")
        total = told.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
        for r in total.where("n > 0").collect():
            centroids[r["cluster"], r["at"]] = r["part"] // r["n"]
    packed.mapInArrow(_assigning(centroids), f"id {of_id}, cluster int, distance long").write.parquet(os.path.join(folder, "assigned"))
    assigned = spark.read.parquet(os.path.join(folder, "assigned"))
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    table = [
        (k, inertia.get(k, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())
    ]
    of_cluster = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(of_cluster, "cluster").select(F.col("id").alias(id_column), *[f.name for f in key.fields[1:]])


def brute_force_sql(clusters: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> str:
    """The query's rows in DuckDB, component by component."""
    steps = [f"""
    good AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {COMPONENTS}
        AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {COMPONENTS}),
    q AS (SELECT vec_id, unnest(range({COMPONENTS})) AS i, unnest([floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding]) AS v FROM good),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM good),
    c0 AS (SELECT k, i, v FROM seeds JOIN q USING (vec_id) WHERE k < {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""
    d{r} AS (SELECT vec_id, k, sum((q.v - c.v) * (q.v - c.v))::BIGINT AS d FROM q JOIN c{r} c USING (i) GROUP BY vec_id, k),
    a{r} AS (SELECT vec_id, unnest(min({{'d': d, 'k': k}}), recursive := true) FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
    s{r} AS (SELECT k, i, sum(v)::BIGINT AS s, count(*) AS n FROM a{r} JOIN q USING (vec_id) GROUP BY k, i),
    c{r + 1} AS (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} c LEFT JOIN s{r} USING (k, i))""")
    return f"""
    WITH {",".join(steps)},
    named AS (SELECT k, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
        (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN named USING (k)"""
