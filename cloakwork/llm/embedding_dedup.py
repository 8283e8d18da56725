"""Near copies among embeddings: small-world graphs per shard, every shard queried, links verified in double precision."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.components import connected_components
from cloakwork.llm.graph_index import FULL_BATCH, SmallWorld
from cloakwork.session import scratch_path

SHARD_BYTES = 8 << 20  # of single-precision vectors in one graph
LEAST_SHARDS = 8  # so that small inputs also use several tasks
QUERIES = 8192  # vectors that are looked up in one shard under one audit
AUDITED = 64  # queries that are answered by brute force at once
LINKED = 32  # audited queries with links to other vectors that must have been seen to trust the beam
HITS = 1 << 20  # links that one step may find, by the audit's mean
FOREST = 1 << 20  # links that are kept before they shrink to a spanning forest
WIDEST = 512  # beam beyond which brute force is no dearer
EXACT_BYTES = 64 << 20  # of products held at once by brute force
MARGIN = 1e-4  # single-precision candidates this far below the threshold are verified too


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _given(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as given: in single precision if they came so, else in double."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(flat.dtype if flat.dtype == np.float32 else np.float64).reshape(len(column), -1)


def _build(table: pa.Table) -> pa.Table:
    """One row: the graph of a shard, with its vectors as given, their classes and copies."""
    raw = _given(table.column("embedding"))
    classes, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
    first = np.argsort(classes)  # a rerun builds the same graph
    graph = SmallWorld(_unit(raw[first]))
    rows = first[graph.order]
    return pa.table(
        {
            "dim": pa.array([raw.shape[1]], pa.int32()), "shard": table.column("shard")[:1], "raw": pa.array([raw[rows].tobytes()], pa.binary()),
            "classes": [classes[rows].astype("<i8").tobytes()], "copies": [copies[rows].astype("<i8").tobytes()],
            "near": [[n.tobytes() for n in graph.near]], "width": pa.array([[n.shape[1] for n in graph.near]], pa.list_(pa.int32())),
        }
    )


def _vectors(raw: bytes, dim: int, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<f{len(raw) // (dim * count)}").reshape(count, dim)


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Least number that links reach from each of ``size`` numbers."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _exact(unit: np.ndarray, vectors: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query number, row) pairs with a dot product >= ``floor``."""
    step, q, r = max(1, EXACT_BYTES // (4 * max(1, len(vectors)))), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(unit), step):
        a, b = np.nonzero(unit[start : start + step] @ vectors.T >= floor)
        q.append(a + start)
        r.append(b)
    return np.concatenate(q), np.concatenate(r)


def _looker(least: float, recall: float, beam: int):
    opened: dict[tuple[int, int], tuple] = {}  # the last shard, as pairs come shard by shard

    def open_shard(table: pa.Table) -> tuple:
        at = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        if at not in opened:
            opened.clear()
            shard = {c: table.column(c)[0].as_py() for c in ("raw", "classes", "copies", "near", "width")}
            classes, copies = np.frombuffer(shard["classes"], "<i8"), np.frombuffer(shard["copies"], "<i8")
            raw = _vectors(shard["raw"], at[0], len(classes))
            near = [np.frombuffer(n, np.int32).reshape(-1, w) for n, w in zip(shard["near"], shard["width"])]
            norms = np.linalg.norm(raw.astype(np.float64), axis=1)
            opened[at] = raw, classes, copies, norms, SmallWorld.restored(np.arange(len(raw)), _unit(raw), near)
        return opened[at]

    def look(queries: pa.Table, shards: pa.Table) -> pa.Table:
        """(class, root, links): copies in this shard that a queried class links to, and links as a spanning forest."""
        empty = pa.table({"class": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not queries.num_rows or not shards.num_rows:
            return empty
        raw, classes, copies, norms, graph = open_shard(shards)
        asked, own = _given(queries.column("embedding")), queries.column("class").to_numpy()
        unit = _unit(asked)
        floor = least - MARGIN
        links, a, b = np.zeros(len(own), np.int64), [], []
        norm = np.linalg.norm(asked.astype(np.float64), axis=1)

        def verify(q: np.ndarray, r: np.ndarray) -> None:
            nonlocal links
            for i in range(0, len(q), 65536):
                x, y = q[i : i + 65536], r[i : i + 65536]
                cosine = np.einsum("nd,nd->n", asked[x].astype(np.float64), raw[y].astype(np.float64)) / (norm[x] * norms[y])
                true = (cosine >= least) & (own[x] != classes[y])
                x, y = x[true], y[true]
                links += np.bincount(x, copies[y], len(own)).astype(np.int64)
                a.append(own[x])
                b.append(classes[y])
                if sum(map(len, a)) > FOREST:
                    a[:], b[:] = forest()

        def forest() -> tuple[list[np.ndarray], list[np.ndarray]]:
            """As few links as join what all the links so far join."""
            nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
            root = nodes[_roots(at[: len(at) // 2], at[len(at) // 2 :], len(nodes))]
            return [nodes[root != nodes]], [root[root != nodes]]

        # the audit: exact answers, which also stand, until enough queries have links to other vectors
        order = np.argsort(own * 2654435761 % (1 << 32), kind="stable")
        audited, seen, hits, truth = 0, 0, 0, [np.zeros(0, np.int64)]
        while audited < len(own) and seen < LINKED:
            part = order[audited : audited + AUDITED]
            q, r = _exact(unit[part], graph.vectors, floor)
            verify(part[q], r)
            other = own[part[q]] != classes[r]
            truth.append((q[other] + audited) * len(raw) + r[other])
            seen += len(np.unique(q[other]))
            audited += len(part)
            hits += len(q)
        step = int(np.clip(HITS * audited // max(1, hits), 16, FULL_BATCH))  # a group of near copies as large as a shard must not fill memory
        truth, rest, wide = np.concatenate(truth), order[audited:], beam
        of_each = np.bincount(truth // len(raw), minlength=audited)
        by_graph = False
        while len(rest) and not by_graph and wide <= WIDEST:  # widen the beam until the audit passes
            found = np.zeros(audited)
            for start in range(0, audited, step):
                q, r = graph.within(unit[order[start : min(audited, start + step)]], floor, min(wide, len(raw)))
                known = truth[np.searchsorted(truth, start * len(raw)) : np.searchsorted(truth, (start + step) * len(raw))]
                found += np.bincount(known // len(raw), np.isin(known, (q + start) * len(raw) + r), audited)
            by_graph = (found[of_each > 0] / of_each[of_each > 0]).mean() >= recall  # each query counts alike, however many links it has
            wide *= 1 if by_graph else 2
        for start in range(0, len(rest), step):
            part = rest[start : start + step]
            q, r = graph.within(unit[part], floor, min(wide, len(raw))) if by_graph else _exact(unit[part], graph.vectors, floor)
            verify(part[q], r)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        nodes, at = np.unique(np.concatenate([a, b, own]), return_inverse=True)
        root = nodes[_roots(at[: len(a)], at[len(a) : 2 * len(a)], len(nodes))]
        total = np.zeros(len(nodes), np.int64)
        total[at[2 * len(a) :]] = links
        kept = (root != nodes) | (total > 0)
        return pa.table({"class": nodes[kept], "root": root[kept], "links": total[kept]})

    return look


def _lookup(least: float, recall: float, beam: int):
    """Each row of a batch is a pair: a shard's graph, and vectors to look up there."""
    look = _looker(least, recall, beam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = pa.Table.from_batches([batch.slice(i, 1)])
                own = np.frombuffer(pair.column("own")[0].as_py(), "<i8")
                asked = _vectors(pair.column("asked")[0].as_py(), pair.column("dim")[0].as_py(), len(own))
                asked = pa.FixedSizeListArray.from_arrays(pa.array(asked.reshape(-1)), asked.shape[1])
                yield from look(pa.table({"class": own, "embedding": asked}), pair).to_batches()

    return run


def link_embeddings(
    vectors: DataFrame, least: float = 0.95, recall: float = 0.99, beam: int = 32, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``id_column, n_links, component_id, kept``: links of cosine >= ``least``, and what they join.

    Equal vectors are one class with a number of copies. Classes are dealt to shards of bounded bytes, each with its own
    hierarchical small-world graph; every class is looked up in every shard of its dimension, QUERIES at once. Pairs of shards are
    made where they are used, from what is stored, so nothing is shuffled for them. A pair answers queries by brute force until
    LINKED of them have links to other vectors (these answers stand), and doubles its beam until the mean share found of such a
    query's links is ``recall``; if WIDEST fails too, or links are too few to tell, brute force answers all of them. Where links
    are found, the search goes on over graph neighbours until none is new. Links are verified on the given values in double
    precision. A pair returns sums and a spanning forest, so a group of near copies costs no pairs outside its tasks, and inside
    only the HITS links of one step and FOREST links that are kept.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of different
    length. Null ids join components but never name one unless all are null; repeated ids are rows of their own; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    folder = scratch_path(spark, "embeddings")

    def kept(frame: DataFrame, name: str, **options) -> DataFrame:
        frame.write.options(**options).parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    inner = F.col("embedding")
    good = (F.size(inner) > 0) & F.forall(inner, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(inner, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("embedding"))
    rows = rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), inner))
    classes = rows.where(inner.isNotNull()).groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = kept(classes.select("embedding", "id", "copies", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("class")), "classes")
    size = classes.agg(F.sum(4 * F.col("dim").cast("long"))).first()[0]
    shards = max(LEAST_SHARDS, math.ceil((size or 0) / SHARD_BYTES))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    fields = "dim int, shard int, raw binary, classes binary, copies binary, near array<binary>, width array<int>"
    graphs = placed.select("dim", "shard", "class", "copies", "embedding").groupBy("dim", "shard").applyInArrow(_build, fields)
    graphs = kept(graphs, "graphs", maxRecordsPerFile=1)  # so that a task opens one graph at a time
    rows_in = F.length("classes") / 8
    part, wide = F.col("part") * QUERIES, (F.length("raw") / rows_in).cast("int")
    asked = graphs.select("dim", "raw", "classes", F.explode(F.sequence(F.lit(0), F.ceil(rows_in / QUERIES).cast("int") - 1)).alias("part")).select(
        "dim", F.substring("raw", part * wide + 1, QUERIES * wide).alias("asked"), F.substring("classes", 8 * part + 1, F.lit(8 * QUERIES)).alias("own")
    )
    pairs = graphs.hint("shuffle_replicate_nl").join(asked, "dim")
    found = kept(pairs.mapInArrow(_lookup(least, recall, beam), "class long, root long, links long"), "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("class <> root"), "class", "root").select(F.col("node").alias("class"), "root")
    named = classes.select("class", "id", "copies").join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = kept(named.join(links, "class", "left"), "named")
    ids = kept(named.groupBy("root").agg(F.min("id").alias("component_id")), "ids")
    told = kept(named.join(ids, "root").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    of_vector = kept(classes.join(told, "class").select("embedding", "component_id", "n_links"), "of_vector")
    component = F.when(inner.isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(of_vector, "embedding", "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
