"""Language-model scores by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import batches as B
from cloakwork.session import scratch_path

END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\n\n")  # no word holds white space
TOKENS = 1_000_000  # tokens whose n-grams meet in one summing task, on average
STEPS = 2  # cells of the held-out histogram per doubling of a probability
MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Tokens of some texts as numbers into ``vocabulary`` (64-bit hashes, the last two START and END)."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray):
        self.codes, self.ends, self.vocabulary = codes.astype(np.int64), ends.astype(np.int64), vocabulary

    @classmethod
    def of(cls, texts: pa.Array) -> "Chunk":
        distinct, codes, offsets = B.word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, names), START, END], np.uint64)
        ends = offsets[1:] + np.arange(1, len(offsets))
        out = np.empty(len(codes) + len(ends), np.int64)
        closing = np.zeros(len(out), bool)
        closing[ends - 1] = True
        out[closing], out[~closing] = len(names) + 1, codes
        return cls(out, ends, hashes)

    def part(self, chosen: np.ndarray) -> "Chunk":
        """Only the chosen texts, with the words that they hold."""
        lengths = np.diff(np.concatenate([[0], self.ends]))
        codes = self.codes[np.repeat(chosen, lengths)]
        last = len(self.vocabulary) - 2
        used = np.unique(codes[codes < last])
        number = np.zeros(last + 2, np.int64)
        number[used], number[last:] = np.arange(len(used)), [len(used), len(used) + 1]
        return Chunk(number[codes], np.cumsum(lengths[chosen]), np.concatenate([self.vocabulary[used], self.vocabulary[last:]]))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-gram hashes in rising order of a local number, that number for each token or -1).

        The n-gram of a token ends at it. One START stands before each text; a token too early for n tokens has none.
        """
        width = np.int64(len(self.vocabulary))
        if n == 1:
            return _mix(self.vocabulary), self.codes  # START is there for its count
        size, start = len(self.codes), np.zeros(len(self.codes), np.int64)
        start[self.starts] = 1
        place = np.arange(size) - np.maximum.accumulate(np.where(start > 0, np.arange(size), 0)) if size else np.zeros(0, np.int64)
        number, value = self.codes, self.vocabulary[self.codes]
        for back in range(1, n):
            earlier = np.concatenate([np.zeros(min(back, size), np.int64), self.codes[: max(0, size - back)]])
            earlier = np.where(place == back - 1, width - 2, earlier)
            value = value * MULT + self.vocabulary[earlier]
            _, number = np.unique(number * width + earlier, return_inverse=True)
        whole = place >= n - 2
        kept = np.unique(number[whole])
        local = np.full(int(number.max()) + 1 if size else 0, -1)
        local[kept] = np.arange(len(kept))
        hashes = np.zeros(len(kept), np.uint64)
        number = np.where(whole, local[number], -1)
        hashes[number[whole]] = value[whole]
        return _mix(hashes + np.uint64(n)), number

    def shifted(self, numbers: np.ndarray, first: int) -> np.ndarray:
        """For each token the number of the n-gram that ends before it; ``first`` at the start of a text."""
        out = np.concatenate([[first], numbers[:-1]])
        out[self.starts] = first
        return out[: len(numbers)]


@dataclass
class Mixture:
    """Weights by bucket of the longest context's count: for orders from the longest down to 1, then the uniform share."""

    weights: np.ndarray
    tokens: int
    words: int


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole binary logarithm of its count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def estimates(chunk: Chunk, counts: list[np.ndarray], tokens: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, probabilities of each order from the longest to 1 and uniform) of each token, from local n-gram counts."""
    order = len(counts)
    numbers = [chunk.grams(n)[1] for n in range(1, order + 1)]
    columns, longest = [], np.zeros(len(chunk.codes), np.int64)
    for n in range(order, 0, -1):
        at = numbers[n - 1]
        own = np.where(at >= 0, counts[n - 1][at] if len(counts[n - 1]) else 0, 0)
        if n == 1:
            columns.append(own / max(1, tokens))
            break
        before = chunk.shifted(numbers[n - 2], len(chunk.vocabulary) - 2 if n == 2 else -1)
        context = np.where(before >= 0, counts[n - 2][before] if len(counts[n - 2]) else 0, 0)
        context = np.where(at >= 0, context, 0)
        columns.append(np.divide(own, context, out=np.zeros(len(own)), where=context > 0))
        longest = context if n == order else longest
    columns.append(np.full(len(chunk.codes), 1 / (words + 1)))
    return bucket(longest), np.stack(columns, axis=1)


def fit_weights(cells: list[tuple[int, float, list[float]]], order: int, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation, bucket by bucket, on (bucket, held-out tokens, mean estimates) cells.

    An unseen longest context has no estimate, so its weight there is 0. Buckets without held-out tokens take the weights of
    the next lower bucket. The uniform share keeps a little, as new words need it.
    """
    top = max([b for b, _, _ in cells], default=0)
    weights = np.zeros((max(64, top + 1), order + 1))
    for b in range(len(weights)):
        own = [(n, p) for k, n, p in cells if k == b]
        if not own:
            weights[b] = weights[b - 1] if b > 1 else np.array([0.0] * (order > 1) + [1.0] * (order + (order == 1)))
            weights[b] /= weights[b].sum()
            continue
        n, p = np.array([x for x, _ in own]), np.array([x for _, x in own])
        share = np.ones(order + 1)
        if b == 0 and order > 1:
            share[0] = 0
        share /= share.sum()
        for _ in range(rounds):
            part = p * share
            part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            share = part.sum(axis=0) / n.sum()
        share[-1] = max(share[-1], 1e-6)
        weights[b] = share / share.sum()
    return weights


def score(
    docs: DataFrame, train: Column, deleted: Column, order: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``id_column, n_tokens, n_known, train_tokens, base_score, score`` of every row, log10 probabilities of whole texts.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. ``train`` says which rows are learned from,
    ``deleted`` which of these are the held-out part: their counts are taken from the totals while the mixture weights are
    fitted on them, and belong to the totals again for the scores. Texts become chunks of token numbers, written once. A chunk
    sends each of its distinct n-grams once to a summing task, and gets back the totals in the same order, so a frequent
    n-gram costs one entry per chunk and nothing is counted in one place. The driver holds the histogram of held-out
    estimates: buckets times half-doublings, a few thousand cells whatever the input.
    Null and empty texts are an end alone; a null ``train`` or ``deleted`` is false; repeated rows and null ids are scored like
    others; without training rows every token has probability 1; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    folder = scratch_path(spark, "lm")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    learned = F.coalesce(train, F.lit(False))
    held = learned & F.coalesce(deleted, F.lit(False))
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), learned.alias("train"), held.alias("held")
    )
    id_type = rows.schema["id"].dataType

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in B.slices(parts, 1):
            whole = Chunk.of(part.column(1))
            trained = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            of_held = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for is_held, chosen in ((True, of_held), (False, ~of_held)):
                if not chosen.any():
                    continue
                chunk = whole.part(chosen)
                lengths = np.diff(np.concatenate([[0], chunk.ends]))
                ids = part.column(0).filter(pa.array(chosen))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([is_held]), pa.array([int(lengths[trained[chosen]].sum())]), pa.array([len(chunk.codes)]),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([trained[chosen].astype(np.uint8).tobytes()], pa.binary()),
                        pa.array([_planes(chunk.ends, "<i4")], pa.binary()), pa.array([_planes(chunk.codes, "<i4")], pa.binary()),
                        pa.array([chunk.vocabulary.tobytes()], pa.binary()),
                    ],
                    ["chunk", "held", "trained", "tokens", "ids", "train", "ends", "codes", "vocabulary"],
                )
                number += 1

    schema = f"chunk long, held boolean, trained long, tokens long, ids array<{id_type.simpleString()}>, train binary, ends binary, codes binary, vocabulary binary"
    chunks = kept(rows.mapInArrow(read, schema), "chunks")
    seen = chunks.agg(F.sum("trained"), F.sum(F.when(F.col("held"), F.col("trained"))), F.sum("tokens")).first()
    n_train, n_held, n_all = (int(x or 0) for x in seen)
    tasks = max(1, math.ceil(n_all * order / TOKENS))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                chunk = _chunk(row)
                lengths = np.diff(np.concatenate([[0], chunk.ends]))
                trained = np.frombuffer(row["train"], np.uint8).astype(bool)
                counted = np.repeat(trained, lengths)
                for n in range(1, order + 1):
                    hashes, number = chunk.grams(n)
                    total = np.bincount(number[counted & (number >= 0)], minlength=len(hashes))
                    if n == 1:
                        total[len(hashes) - 2] = trained.sum()  # START, as context
                    sent = []
                    for task, own in _dealt(hashes, tasks):
                        steps = np.diff(hashes[own], prepend=np.uint64(0))  # rising, so the steps have empty high bytes
                        sent.append((task, n, row["chunk"], row["held"], _planes(steps, "<u8"), _planes(total[own], "<u4")))
                    if sent:
                        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*sent), kinds)], ["task", "n", "chunk", "held", "grams", "train"]
                        )

    def add_up(table: pa.Table) -> pa.Table:
        grams = [np.cumsum(_whole(x, "<u8"), dtype=np.uint64) for x in table.column("grams").to_pylist()]
        own = np.concatenate([_whole(x, "<u4") for x in table.column("train").to_pylist()])
        held_ = table.column("held").to_pylist()
        distinct, code = np.unique(np.concatenate(grams), return_inverse=True)
        of_held = np.repeat(held_, [len(g) for g in grams])
        total, gone = np.bincount(code, own).astype(np.int64), np.bincount(code, own * of_held).astype(np.int64)
        parts = np.split(code, np.cumsum([len(g) for g in grams])[:-1])
        first = table.column("n")[0].as_py() == 1
        words = int(((total > 0) & (distinct != _mix(np.array([START], np.uint64))[0])).sum()) if first else 0
        return pa.table(
            {
                "chunk": table.column("chunk"), "n": table.column("n"), "task": table.column("task"),
                "train": pa.array([_planes(total[c], "<i8") for c in parts], pa.binary()),
                "held": pa.array([_planes(gone[c], "<i8") if h else b"" for c, h in zip(parts, held_)], pa.binary()),
                "words": pa.array([words, *[0] * (len(grams) - 1)], pa.int64()),
            }
        )

    grams = chunks.select("chunk", "held", "train", "ends", "codes", "vocabulary").mapInArrow(
        send, "task int, n int, chunk long, held boolean, grams binary, train binary"
    )
    totals = kept(
        grams.groupBy("n", "task").applyInArrow(add_up, "chunk long, n int, task int, train binary, held binary, words long"), "totals"
    )
    n_words = int(totals.agg(F.sum("words")).first()[0] or 0)

    def local_counts(table: pa.Table, chunk: Chunk, less_held: bool) -> list[np.ndarray]:
        """Totals in the order of the chunk's own n-grams."""
        got: dict[tuple[int, int], np.ndarray] = {}
        for row in table.select(["n", "task", "train", "held"]).to_pylist():
            value = _whole(row["train"], "<i8")
            got[row["n"], row["task"]] = value - _whole(row["held"], "<i8") if less_held else value
        out = []
        for n in range(1, order + 1):
            hashes = chunk.grams(n)[0]
            counts = np.zeros(len(hashes), np.int64)
            for task, own in _dealt(hashes, tasks):
                counts[own] = got[n, task]
            out.append(counts)
        return out

    def held_out(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"bucket": [], "cell": [], "tokens": [], "sums": []}
        for row in left.to_pylist():
            chunk = _chunk(row)
            place, p = estimates(chunk, local_counts(right, chunk, True), n_train - n_held, n_words)
            level = np.where(p > 0, np.floor(STEPS * -np.log2(np.maximum(p, 1e-300))) + 1, 0).astype(np.int64)
            _, first, code = np.unique(np.column_stack([place, level]), axis=0, return_index=True, return_inverse=True)
            code = code.reshape(-1)
            empty["bucket"] += place[first].tolist()
            empty["cell"] += ["-".join(map(str, x)) for x in level[first].tolist()]
            empty["tokens"] += np.bincount(code).tolist()
            empty["sums"] += np.stack([np.bincount(code, p[:, j]) for j in range(p.shape[1])], axis=1).tolist()
        kinds = {"bucket": pa.int64(), "cell": pa.string(), "tokens": pa.int64(), "sums": pa.list_(pa.float64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in empty.items()})

    of_held = chunks.where("held").select("chunk", "ends", "codes", "vocabulary")
    their = totals.join(of_held.select("chunk"), "chunk", "left_semi").select("chunk", "n", "task", "train", "held")
    cells = of_held.groupBy("chunk").cogroup(their.groupBy("chunk")).applyInArrow(held_out, "bucket long, cell string, tokens long, sums array<double>")
    summed = cells.groupBy("bucket", "cell").agg(F.sum("tokens").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(order + 1)])
    table = [(r["bucket"], r["n"], [r[f"s{j}"] / r["n"] for j in range(order + 1)]) for r in summed.collect()]
    weights = fit_weights(table, order) if n_train else np.eye(1, order + 1, order)  # nothing learned: the uniform share alone
    model = Mixture(weights, n_train, n_words)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for row in left.to_pylist():
            chunk = _chunk(row)
            counts = local_counts(right, chunk, False)
            place, p = estimates(chunk, counts, model.tokens, model.words)
            mixed = (p * model.weights[np.minimum(place, len(model.weights) - 1)]).sum(axis=1)
            seen_ = counts[0][chunk.codes]
            base = np.log10((seen_ + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            ends = np.concatenate([[0], chunk.ends])
            done.append((np.diff(ends), B.sums((seen_ > 0).astype(np.int64), ends), B.sums(base, ends), B.sums(np.log10(mixed), ends)))
        columns = [np.concatenate(c) for c in zip(*done)]
        ids = pa.concat_arrays([x for c in left.column("ids").chunks for x in [c.flatten()]])
        return pa.table(
            {
                id_column: ids, "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), model.tokens), pa.int64()), "base_score": pa.array(columns[2]), "score": pa.array(columns[3]),
            }
        )

    out = B.result_schema(docs, id_column, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return (
        chunks.select("chunk", "ids", "ends", "codes", "vocabulary").groupBy("chunk")
        .cogroup(totals.select("chunk", "n", "task", "train", "held").groupBy("chunk")).applyInArrow(judge, out)
    )


def _chunk(row: dict) -> Chunk:
    return Chunk(_whole(row["codes"], "<i4"), _whole(row["ends"], "<i4"), np.frombuffer(row["vocabulary"], np.uint64))


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    """First bytes of all numbers, then second bytes and so on: high bytes are mostly 0, which compresses to nothing."""
    whole = np.ascontiguousarray(numbers.astype(kind))
    return np.ascontiguousarray(whole.view(np.uint8).reshape(len(whole), whole.itemsize).T).tobytes()


def _whole(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _dealt(hashes: np.ndarray, tasks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(task, places of its hashes, by rising hash), the same in every pass; a task has a range of hashes."""
    order = np.argsort(hashes, kind="stable")
    edges = np.array([(t << 64) // tasks for t in range(tasks)], np.uint64)
    ends = np.append(np.searchsorted(hashes[order], edges), len(hashes))
    for task in range(tasks):
        if ends[task + 1] > ends[task]:
            yield task, order[ends[task] : ends[task + 1]]
