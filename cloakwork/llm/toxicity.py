"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import batches as B

PREFIXES = (4, 5, 6)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»‘’“”…"
BLOCK = 64  # examples in a block of the index
REMEMBERED = 20_000  # equal vectors that a task looks up once
FIRST = 4  # blocks read before others are ruled out; where more than these are left, columns are read whole
TRIED = 8  # vectors in a row whose bounds ruled out too little
UNBOUND = 63  # vectors that are then read whole before bounds are tried again
DENSE_BYTES = 16 << 20  # of a table of the columns that most examples hold
LEAST_DENSE = 16  # examples that hold a column of that table
TOGETHER = 256  # vectors looked up in the table at once
SLICE = 2 << 20  # bytes of text whose terms are counted at once
ODD = r"[^\x00-\x{12F}\x{131}-\x{24F}\x{400}-\x{4FF}]"  # characters that Arrow may lower-case otherwise than Python, and more


def terms(words: pa.Array) -> list[pa.Array]:
    """Words without their marks, lower-cased, and their beginnings (many languages vary the ends); null where there is none."""
    lowered = pc.utf8_lower(words)
    odd = pc.match_substring_regex(words, ODD)
    if pc.any(odd).as_py():
        lowered = pc.replace_with_mask(lowered, odd, pa.array([w.lower() for w in pc.filter(words, odd).to_pylist()], words.type))
    word = pc.utf8_trim(lowered, EDGES)
    size, begun = pc.utf8_length(word), pc.binary_join_element_wise("^", word, "")
    cut = [pc.utf8_slice_codeunits(pc.if_else(pc.greater(size, n), begun, None), 0, n + 1) for n in PREFIXES]
    return [pc.if_else(pc.greater(size, 0), word, None), *cut]


class Columns:
    """Column numbers of terms, known by sorted 64-bit hashes: 20 bytes a term, where a dict of strings takes ten times as much."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.sorted = hashes[self.order]

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.__init__(hashes)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, asked: pa.Array) -> np.ndarray:
        """The column of each term, -1 for null and for a term that has none."""
        out = np.full(len(asked), -1, np.int32)
        wanted = B.hashes(pc.drop_null(asked))
        if not len(self.sorted) or not len(wanted):
            return out
        given = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
        rising = np.argsort(wanted)  # neighbours are sought sooner
        wanted = wanted[rising]
        at = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
        out[given[rising]] = np.where(self.sorted[at] == wanted, self.order[at], np.int32(-1))
        return out

    def __getitem__(self, term: str) -> int:
        column = int(self.of(pa.array([term], pa.string()))[0])
        if column < 0:
            raise KeyError(term)
        return column


@dataclass
class Space:
    """Terms with their IDF."""

    columns: Columns
    idf: np.ndarray

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, weight) of each text's vector of length 1, sorted by row and column; texts without terms have none."""
        row, column, count = self.counts(texts)
        return row, column, self.weights(row, column, count, len(texts))

    def weights(self, row: np.ndarray, column: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """Weights in vectors of length 1 of columns that stand ``count`` times in their row."""
        weight = (1 + np.log(count.astype(np.int64))) * self.idf[column]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
        return weight / norm[row]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, times) of each text's terms, sorted by row and column."""
        distinct, codes, offsets = B.word_codes(texts)
        of_word = np.stack([self.columns.of(t) for t in terms(distinct)], axis=1)
        at = np.flatnonzero((of_word >= 0).any(axis=1)[codes])
        width = max(1, len(self.columns))
        begin = np.repeat(np.arange(len(texts)) * width, np.diff(offsets))[at]
        column = of_word[codes[at]]
        key, count = np.unique((begin[:, None] + column)[column >= 0], return_counts=True)
        return key // width, key % width, count


class BlockMaxIndex:
    """Examples in blocks, with the largest weight of each column in each block, and the postings of each column.

    A weight is the level of a posting times a factor of its column and one of its example; most levels are 1 (terms that stand
    once in their text), so most postings are the number of an example alone. The columns that most examples hold, as many as
    DENSE_BYTES take, stand in a table instead: their part of the cosine is a product for many vectors. Products in
    the table are near ones (32-bit floats); for examples that may be among the best they are summed in double precision.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int):
        lengths = np.array([len(c) for c, _ in vectors], np.int32)
        column = np.concatenate([c for c, _ in vectors]) if vectors else np.zeros(0, np.int32)
        levels, level = np.unique(np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0), return_inverse=True)
        self._lay_out(lengths, column.astype(np.int32), level.astype(np.int32), levels, np.ones(width), np.ones(len(vectors)))

    @classmethod
    def of(cls, lengths: np.ndarray, column: np.ndarray, level: np.ndarray, levels: np.ndarray, of_column: np.ndarray, of_example: np.ndarray) -> BlockMaxIndex:
        """The index of vectors that stand one behind the other; ``level`` numbers ``levels``."""
        index = cls.__new__(cls)
        index._lay_out(lengths, column, level, levels, of_column, of_example)
        return index

    def _lay_out(self, lengths: np.ndarray, column: np.ndarray, level: np.ndarray, levels: np.ndarray, of_column: np.ndarray, of_example: np.ndarray) -> None:
        self.size, self.wasted, self.unbound, width = len(lengths), 0, 0, len(of_column)
        self.blocks = max(1, (self.size + BLOCK - 1) // BLOCK)
        self.column, self.level, self.levels, self.of_column = column, level, np.append(levels, 0.0), of_column
        self.of_example = np.append(of_example, np.zeros(self.blocks * BLOCK - self.size))
        self.ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.asked, self.marked = np.zeros(width), np.zeros(width, bool)  # by column, what a vector asks for while it is looked up
        held = np.bincount(column, minlength=width)
        common = np.argsort(-held, kind="stable")[: DENSE_BYTES // (4 * self.blocks * BLOCK)]
        common = common[held[common] >= LEAST_DENSE]
        self.place = np.full(width, -1, np.int32)  # of a column in the table
        self.place[common] = np.arange(len(common))
        self.margin = 2 * (len(common) + 8) * 2.0**-24  # twice what 32-bit sums of products of vectors of length 1 can be off by
        row = np.repeat(np.arange(self.size, dtype=np.min_scalar_type(self.blocks * BLOCK)), lengths)
        at = self.place[column]
        here = np.flatnonzero(at >= 0)
        self.table = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.table[at[here], row[here]] = levels[level[here]] * self.of_example[row[here]]
        self.in_table = np.full(self.table.shape, len(levels), np.min_scalar_type(len(levels)))  # levels; the last is that of no posting
        self.in_table[at[here], row[here]] = level[here]
        rest = np.flatnonzero(at < 0)
        del at, here
        rest = rest[np.argsort(column[rest], kind="stable")].astype(np.int32)  # rows rise already
        row, level, column = row[rest], level[rest], column[rest]
        del rest
        once = (levels == 1)[level]
        self.once, self.once_start = row[once], self._starts(column[once], width)
        self.row, self.row_start, self.times = row[~once], self._starts(column[~once], width), levels[level[~once]]
        block = (row // BLOCK).astype(np.min_scalar_type(self.blocks))
        first = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (block[1:] != block[:-1]))[: len(column)])
        limit = levels.astype(np.float32)[level] * self.of_example.astype(np.float32)[row]
        self.limit = np.maximum.reduceat(limit, first) * np.float32(1 + 2**-20) if len(first) else limit  # no rounding is below
        self.block = block[first]  # of each run, the postings of one column in one block
        self.start = self._starts(column[first], width)

    @staticmethod
    def _starts(column: np.ndarray, width: int) -> np.ndarray:
        """Where each column begins among sorted ones, and the end."""
        return np.concatenate([[0], np.cumsum(np.bincount(column, minlength=width))]).astype(np.int32)

    @staticmethod
    def _stretches(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each stretch, all positions in the stretches)."""
        each = (stop - start).astype(np.int64)
        ends = np.cumsum(each)
        position = np.repeat(start - (ends - each), each)
        position += np.arange(len(position))
        return each, position

    def _exactly(self, found: np.ndarray) -> np.ndarray:
        """Cosines of these examples with what is asked."""
        if not len(found):
            return np.zeros(0)
        cuts = list(zip(self.ends[found].tolist(), self.ends[found + 1].tolist()))
        ends = np.cumsum([b - a for a, b in cuts])
        column = np.concatenate([self.column[a:b] for a, b in cuts])
        shared = np.flatnonzero(self.marked[column])
        level = np.concatenate([self.level[a:b] for a, b in cuts])[shared]
        each = np.diff(np.searchsorted(shared, ends), prepend=0)
        part = self.asked[column[shared]] * self.levels[level]
        return np.bincount(np.repeat(np.arange(len(found)), each), part, len(found)) * self.of_example[found]

    def _read(self, blocks: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of all examples in the blocks with a cosine above 0."""
        found = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        found = found[(found < self.size) & (found != but)]
        scores = self._exactly(found)
        return found[scores > 0], scores[scores > 0]

    def _read_whole(self, base: np.ndarray, column: np.ndarray, asked: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of all examples with a cosine above 0 that may be among the best k."""
        at = self.place[column]
        rest = at < 0
        rare, of_rare, at = column[rest], asked[rest], at[~rest]
        each, position = self._stretches(self.once_start[rare], self.once_start[rare + 1])
        score = np.bincount(self.once[position], np.repeat(of_rare, each), len(base))
        each, position = self._stretches(self.row_start[rare], self.row_start[rare + 1])
        part = np.repeat(of_rare, each)
        part *= self.times[position]
        score = (score + np.bincount(self.row[position], part, len(base))) * self.of_example  # counts of nothing are whole numbers
        near = score + base
        if but >= 0:
            near[but] = 0
        least = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else 0.0
        found = np.flatnonzero((near > 0) & (near >= least - self.margin))
        exact = asked[~rest] @ self.levels[self.in_table[at[:, None], found]]
        return found, score[found] + exact * self.of_example[found]

    @staticmethod
    def _best(found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-12
            found, scores = found[near], scores[near]
        scores = np.round(scores, 12)
        best = np.lexsort((found, -scores))[:k]
        return found[best], np.minimum(scores[best], 1.0)

    def _nearest(self, base: np.ndarray, column: np.ndarray, asked: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """``base``: by example, what the columns of the table give."""
        if self.unbound:
            self.unbound -= 1
            return self._best(*self._read_whole(base, column, asked, k, but), k)
        rare = column[self.place[column] < 0]
        each, run = self._stretches(self.start[rare], self.start[rare + 1])
        part = np.repeat(self.asked[rare], each)
        part *= self.limit[run]
        bound = base.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(self.block[run], part, self.blocks)
        bound = np.where(bound > 0, bound + self.margin, 0.0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores = self._read(order[:FIRST], but)
        wide = False
        if len(order) > FIRST:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
            more_blocks = order[FIRST:]
            more_blocks = more_blocks[bound[more_blocks] >= floor - 1e-12]
            wide = len(more_blocks) > FIRST
            if wide:  # columns are read sooner than the examples of many blocks
                found, scores = self._read_whole(base, column, asked, k, but)
            elif len(more_blocks):
                more, theirs = self._read(more_blocks, but)
                found, scores = np.append(found, more), np.append(scores, theirs)
        self.wasted = self.wasted + 1 if wide else 0
        if self.wasted >= TRIED:
            self.unbound, self.wasted = UNBOUND, TRIED - 1  # one more vector like these, and the next ones are read whole again
        return self._best(found, scores, k)

    def nearest_of_each(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k examples of largest cosine above 0 (ties: the lower number) of each vector of length 1, exactly; ``but`` is left out.

        A block's bound is its largest product in the table and the sum of query weight times block maximum over the other
        columns. The FIRST blocks of largest bound give the k-th best so far; after these, only blocks whose bound reaches it are
        read, and none if there is none. Where bounds rule out too little for TRIED vectors in a row, they cost more than they
        spare: the next UNBOUND vectors are read whole, with the same sums, then bounds are tried again.
        """
        out = []
        for first in range(0, len(vectors), TOGETHER):
            part = [(column, weight * self.of_column[column]) for column, weight in vectors[first : first + TOGETHER]]
            common = np.zeros((len(part), len(self.table)), np.float32)
            for i, (column, asked) in enumerate(part):
                at = self.place[column]
                common[i, at[at >= 0]] = asked[at >= 0]
            base = common @ self.table
            for i, (column, asked) in enumerate(part):
                self.asked[column], self.marked[column] = asked, True
                out.append(self._nearest(base[i], column, asked, k, but[first + i] if but else -1))
                self.marked[column] = False
        return out

    def nearest(self, column: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of_each([(column, weight)], k, [but])[0]


@dataclass
class Examples:
    """The examples' terms one behind the other, as columns and how often they stand in their text: 5 bytes each, mostly."""

    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))


@dataclass
class Judge:
    """All that scoring needs; its size is bounded by the number of examples and terms. The driver has no index: each worker
    lays it out from the examples."""

    space: Space
    examples: Examples
    ids: list[str]
    toxic: np.ndarray
    class_weight: np.ndarray  # labelled rows that each example stands for
    k: int
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))  # votes at which the calibrated score rises
    levels: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))
    silent: float = 0.5  # score of texts without a neighbour
    sent: Broadcast | None = None  # this judge, without steps and levels, where workers have it already
    _votes: dict = field(default_factory=dict)

    @cached_property
    def weights(self) -> np.ndarray:
        of = self.examples
        row = np.repeat(np.arange(len(of.lengths)), of.lengths)
        return self.space.weights(row, of.column, of.count, len(of.lengths))

    @cached_property
    def index(self) -> BlockMaxIndex:
        of, scale = self.examples, np.ones(len(self.examples.lengths))
        ends = np.concatenate([[0], np.cumsum(of.lengths, dtype=np.int64)])
        seen = np.flatnonzero(np.bincount(of.count))
        levels, number = 1 + np.log(seen), np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.min_scalar_type(len(seen)))
        number[seen] = np.arange(len(seen))
        level = number[of.count]
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if b > a:
                scale[i] = 1 / np.linalg.norm(levels[level[a:b]] * self.space.idf[of.column[a:b]])
        return BlockMaxIndex.of(of.lengths, of.column, level, levels, self.space.idf, scale)

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(column, weight) of an example's vector."""
        part = slice(self.index.ends[i], self.index.ends[i + 1])
        column, count = self.examples.column[part], self.examples.count[part]
        return column, self.space.weights(np.zeros(len(column), np.int64), column, count, 1)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = self.class_weight[found] * cosine / (1.0 + 1e-3 - cosine)  # near examples count more
        return float((weight * self.toxic[found]).sum() / weight.sum())

    def calibrated(self, vote: float | None) -> float:
        return self.silent if vote is None else float(self.levels[max(0, np.searchsorted(self.steps, vote, "right") - 1)])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        row, column, weight = self.space.vectors(texts)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        scores, evidence = np.full(len(texts), self.silent), [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        if len(self._votes) > REMEMBERED:
            self._votes.clear()
        keys, new = {}, {}
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[i], bounds[i + 1])
            keys[i] = xxhash.xxh3_128_digest(column[part].tobytes() + weight[part].tobytes())
            if keys[i] not in self._votes:
                new[keys[i]] = column[part], weight[part]
        for key, (found, cosine) in zip(new, self.index.nearest_of_each(list(new.values()), self.k)):
            self._votes[key] = (self.calibrated(self.vote(found, cosine)) if len(found) else self.silent), (found, cosine)
        for i, key in keys.items():
            scores[i], evidence[i] = self._votes[key]
        return scores, evidence


def rising_steps(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the vote by pooling neighbours that fall; half a row of each class softens a level."""
    levels: list[list[float]] = []  # [first vote, toxic weight, weight, rows]
    for v in np.unique(votes):
        at = votes == v
        levels.append([v, float((weight * toxic)[at].sum()), float(weight[at].sum()), float(at.sum())])
        while len(levels) > 1 and levels[-2][1] * levels[-1][2] >= levels[-1][1] * levels[-2][2]:
            last = levels.pop()
            levels[-1] = [levels[-1][0], *(a + b for a, b in zip(levels[-1][1:], last[1:]))]
    steps = np.array([x[0] for x in levels])
    return steps, np.array([(x[1] / x[2] * x[3] + 0.5) / (x[3] + 1) for x in levels])


def _terms_of(texts: DataFrame) -> Columns:
    """All terms of a column of texts, numbered in their order; only hashes come to the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.forget()
        seen: set[str] = set()
        for part in B.slices(parts, 0, SLICE):
            for found in terms(B.word_codes(part.column(0))[0]):
                seen.update(pc.unique(pc.drop_null(found)).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["term"])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(B.hashes(part.column(0)).view(np.int64))], ["hash"])

    found = texts.mapInArrow(run, "term string").distinct().orderBy("term").mapInArrow(hashed, "hash long").toArrow()
    return Columns(found.column(0).to_numpy().view(np.uint64))


def _texts_that_hold(texts: DataFrame, sent: Broadcast[Space]) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each term), summed in each task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.forget()
        space = sent.value
        seen, total = np.zeros(len(space.columns), np.int64), 0
        for part in B.slices(parts, 0, SLICE):
            seen += np.bincount(space.counts(part.column(0))[1], minlength=len(seen))
            total += part.num_rows
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(seen[held], total))], ["term", "n"])

    sums = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(sent.value.columns) + 1, np.int64)  # the last one is the number of texts
    counts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return int(counts[-1]), counts[:-1]


def learn(
    docs: DataFrame, labels: DataFrame, most_examples: int = 4096, k: int = 15, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Judge:
    """Examples, terms, index and calibration.

    The fit is bounded: at most ``most_examples`` labelled documents of each class (those with the least hash of their id). Their
    vectors hold every term that any example has, however rare; IDF counts every document. Words that no example has add
    nothing to a product and are not part of a text's length either: they would scale its cosines alike. Each example stands
    for as many labelled rows as its class has to one example. Only vectors leave the tasks. Null ids and labels are left
    out; an id labelled twice is toxic if half its labels say so. Without examples of both classes the score is their share
    (0.5 if there are none).
    """
    known = F.col(id_column).isNotNull() & F.col(label_column).isNotNull()
    votes = labels.where(known).groupBy(F.col(id_column).alias("_id")).agg((F.avg(label_column) >= 0.5).alias("_toxic"))
    given = {r["_toxic"]: r["count"] for r in votes.groupBy("_toxic").count().collect()}
    first = [votes.where(F.col("_toxic") == v).orderBy(F.xxhash64("_id"), "_id").limit(most_examples) for v in (False, True)]
    chosen = first[0].unionByName(first[1])
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id")  # at most 2 * most_examples ids

    def prior(share: float) -> Judge:
        return Judge(Space(Columns(np.zeros(0, np.uint64)), np.zeros(0)), Examples(), [], np.zeros(0), np.zeros(0), k, silent=share)

    total = sum(given.values())
    if len(given) < 2:
        return prior((given.get(True, 0) + 0.5) / (total + 1))
    n = {r["_toxic"]: r["count"] for r in rows.groupBy("_toxic").count().collect()}
    if len(n) < 2:
        return prior((given.get(True, 0) + 0.5) / (total + 1))
    columns = _terms_of(rows.select("_text"))
    bare = Space(columns, np.ones(len(columns)))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(bare)
    everything, seen = _texts_that_hold(texts.select("_text"), sent)
    sent.destroy()
    space = Space(columns, np.log((1 + everything) / (1 + seen)) + 1)
    del bare, seen
    sent = context.broadcast(space)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, 1, SLICE):
            row, column, count = sent.value.counts(part.column(1))
            weight = sent.value.weights(row, column, count, part.num_rows)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            out = []
            for a, b in zip(ends, ends[1:]):
                heaviest = column[a:b][np.argsort(-weight[a:b], kind="stable")[:BLOCK]]
                small = "<u1" if b == a or count[a:b].max() < 256 else "<u4"
                out.append((heaviest.astype(">u4").tobytes(), column[a:b].astype("<i4").tobytes(), count[a:b].astype(small).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *(pa.array(c, pa.binary()) for c in zip(*out))], ["id", "toxic", "head", "cols", "counts"]
            )

    vectors = rows.select(F.col("_id").cast("string").alias("id"), "_text", "_toxic").mapInArrow(
        run, "id string, toxic boolean, head binary, cols binary, counts binary"
    )
    # one row per example even where ids repeat, so the bound holds; like examples stand in one block
    once = vectors.groupBy("id").agg(F.min(F.struct("cols", "counts", "toxic", "head")).alias("v")).select("id", "v.*")
    found = once.toArrow()
    sent.destroy()
    heads, names = found.column("head").to_pylist(), found.column("id").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (heads[i], names[i]))
    cols, counts = ([np.frombuffer(x.as_buffer() or b"", np.uint8) for x in found.column(c)] for c in ("cols", "counts"))
    lengths = np.array([len(cols[i]) // 4 for i in order], np.int32)
    counted = [counts[i] if 4 * len(counts[i]) == len(cols[i]) else counts[i].view("<u4") for i in order]
    examples = Examples(lengths, np.concatenate([cols[i] for i in order]).view("<i4"), np.concatenate(counted))
    toxic, ids = found.column("toxic").to_numpy()[order].astype(float), [names[i] for i in order]
    del found, cols, counts, counted, heads, names
    stands_for = {v: given[v] / max(1, int((toxic == v).sum())) for v in (False, True)}
    weight = np.array([stands_for[bool(t)] for t in toxic])
    judge = Judge(space, examples, ids, toxic, weight, k)
    sent = context.broadcast(judge)
    own = _votes_of_examples(docs.sparkSession, sent, len(ids))
    quiet = np.isnan(own)
    judge.silent = float(((weight * toxic)[quiet].sum() + 0.5) / (weight[quiet].sum() + 1))
    if (~quiet).any():
        judge.steps, judge.levels = rising_steps(own[~quiet], toxic[~quiet], weight[~quiet])
    judge.sent = sent
    return judge


def _votes_of_examples(spark: SparkSession, sent: Broadcast[Judge], examples: int) -> np.ndarray:
    """What each example's neighbours say without it, to calibrate on; NaN where it has none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            mine, asked = sent.value, part.column(0).to_numpy()
            pairs = [mine.example(i) for i in asked.tolist()]
            votes = [mine.vote(*near) if len(near[0]) else np.nan for near in mine.index.nearest_of_each(pairs, mine.k, asked.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(votes, float))], ["example", "vote"])

    found = spark.range(examples).mapInArrow(run, "example long, vote double").toArrow()
    own = np.full(examples, np.nan)
    own[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return own


def score(docs: DataFrame, judge: Judge, text_column: str = "text", into: str = "_toxicity") -> DataFrame:
    """The rows of ``docs`` with a struct of ``score`` (0 to 1) and ``evidence``, the nearest examples with cosine and label.

    Only the text is looked at. Null, empty and other texts without a term of the examples have no neighbours and get the share of toxic
    rows among such examples. Ties go to the example that stands first in the index; repeated rows score alike; an empty
    table stays empty. Evaluated once per row, in slices of bounded bytes.
    """
    sent = judge.sent or docs.sparkSession.sparkContext.broadcast(judge)
    fit = judge.steps, judge.levels, judge.silent
    kind = pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("toxic", pa.bool_())])

    @F.arrow_udf("score double, evidence array<struct<example string, cosine double, toxic boolean>>")
    def toxicity(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        B.forget()
        mine = sent.value
        mine.steps, mine.levels, mine.silent = fit
        names = np.array(mine.ids, object)
        for whole in parts:
            done = []
            for part in B.slices([pa.RecordBatch.from_arrays([whole], ["text"])], 0, SLICE):
                scores, evidence = mine.score(part.column(0))
                ends = np.cumsum([0, *(len(f) for f, _ in evidence)]).astype(np.int32)
                number = np.concatenate([f for f, _ in evidence])
                near = pa.StructArray.from_arrays(
                    [pa.array(names[number] if len(names) else [], pa.string()), pa.array(np.concatenate([c for _, c in evidence])), pa.array(mine.toxic[number] > 0.5)],
                    fields=list(kind),
                )
                lists = pa.ListArray.from_arrays(pa.array(ends), near)
                done.append(pa.StructArray.from_arrays([pa.array(scores), lists], ["score", "evidence"]))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("score", pa.float64()), ("evidence", pa.list_(kind))]))

    return docs.withColumn(into, toxicity.asNondeterministic()(F.col(text_column).cast("string")))
