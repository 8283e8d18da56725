"""Jaccard join of word shingle sets by PartEnum signatures, with exact verification."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import batches as B
from cloakwork.llm.components import connected_components
from cloakwork.session import cut, scratch_path

PARTS = 3  # second-level partitions of a group; a signature takes all but one of them
SPARE = 2  # groups beyond the need, so that groups with empty partitions can be passed over; none where few differ
FEW = 4  # differences below which no spare groups are added: small sets would leave them empty
SKETCH = 128  # counts of shingles by hash that bound the difference of two sets from below
SIGNATURES = 2_000_000  # signatures that meet in one reducing task
SENT = 5  # bytes of a signature that are sent; sets that only share these meet, and are verified like all others
SLICE = 4 << 20  # bytes of text whose shingles a task holds at once
TASK_BYTES = 32 << 20  # bytes of sets whose pairs one task verifies; larger buckets are cut into blocks
TESTED = 2_000_000  # failed pairs that a task remembers
LEAF = 64  # members of a bucket up to which all its pairs are laid out at once
HELD_WORDS = 1 << 21  # words of parity sketches compared in one step
SKETCH_BYTES = 4 << 20  # bytes of parity sketches that a task holds
UNIT_ROWS = 20_000  # members of buckets that stay together in one task of sketches
AT_ONCE = 1_000_000  # shingles of other sets that one set is compared with in one step
SALTS = 32  # tasks that may share the rows of one least member
SMALL = 1_000_000  # rows of 16 bytes that a broadcast may hold, checked by count
_MULT = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of each text; a shorter text is one shingle, a text without
    words has none. Words stand between ASCII white space, A-Z lower-cased."""
    distinct, codes, offsets = B.word_codes(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct))
    word = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(word)
    value = np.zeros(max(0, n - size + 1), np.uint64)
    for step in range(size):
        value = value * _MULT + word[step : step + len(value)]
    value, out = spread(value), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(value[a : b - size + 1]))
        elif b > a:
            whole = xxhash.xxh3_64_intdigest(np.append(word[a:b], np.uint64(b - a)).tobytes())
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class SizeBands:
    """Bands of set sizes such that two sets with Jaccard >= percent/100 lie in one band or in neighbouring ones."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low.append(self.low[-1] * 100 // percent + 1)
        self.starts = np.array(self.low)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1

    def groups(self, band: int) -> tuple[int, int]:
        """(first-level groups, spare ones among them) for pairs whose larger set lies in the band.

        Such a pair differs in at most k = floor(2 * largest size * (1 - j) / (1 + j)) shingles, so at most k // 2 groups hold
        two differences or more: in the spare groups and one more, at most one of the PARTS partitions differs. Sets too small
        to differ at all are equal or not similar: they need no group.
        """
        largest = self.low[band] * 100 // self.percent
        k = 2 * largest * (100 - self.percent) // (100 + self.percent)
        spare = SPARE if k >= FEW else 0
        return (k // 2 + 1 + spare, spare) if k else (0, 0)


def signatures(sets: list[np.ndarray], bands: SizeBands) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature), by set: PartEnum signatures for the set's own band and the next one.

    The shingle domain is dealt to groups and their partitions by hash; a signature is the content of all but one partition
    of a group, with the band, the group and the partition that is left out. A group whose partitions are all empty but one
    says little: it is passed over, unless a set has more of them than spare groups (then none is). A similar pair has one
    more group with at most one difference than there are spare ones, so one of these stays for both sets: none is missed.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(float), (values >> np.uint64(32)).astype(float)
    band = bands.band(np.maximum(sizes, 1))
    per_band, spare = np.array([bands.groups(i) for i in range(len(bands.low) - 1)], np.int64).T
    out_set, out_sig = [], []
    for ahead in (0, 1):
        tag = band + ahead
        groups = np.where(sizes > 0, per_band[np.minimum(tag, len(per_band) - 1)], 0)
        if not groups.any():
            continue
        grouped = groups[owner] > 0
        first = np.cumsum(groups) - groups
        total = int(groups.sum())
        held, by = values[grouped], owner[grouped]
        place = spread(held ^ (tag[by].astype(np.uint64) * _MULT)) % (groups[by] * PARTS).astype(np.uint64)
        at = first[by] * PARTS + place.astype(np.int64)
        width = total * PARTS
        count = np.bincount(at, minlength=width).reshape(-1, PARTS)
        # sums of 64-bit hashes, from halves that doubles hold exactly
        low_sum, high_sum = (np.bincount(at, part[grouped], width).astype(np.uint64) for part in (low, high))
        content = low_sum + (high_sum << np.uint64(32))
        content = spread(content).reshape(-1, PARTS)
        of = np.repeat(np.arange(len(sets)), groups)
        number = np.arange(total) - first[of]
        poor = (count == 0).sum(axis=1) >= PARTS - 1
        many = np.bincount(of[poor], minlength=len(sets)) > spare[np.minimum(tag, len(per_band) - 1)]
        used = ~poor | many[of]
        head = spread((tag[of] << 32 | number).astype(np.uint64))
        for left_out in range(PARTS):
            value = head + np.uint64(left_out)
            for part in range(PARTS):
                if part != left_out:
                    value = value * _MULT + content[:, part]
            out_set.append(of[used])
            out_sig.append(spread(value[used]))
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number, value = np.concatenate(out_set), np.concatenate(out_sig)
    order = np.argsort(number, kind="stable")
    return number[order], value[order]


def parities(shingles: np.ndarray) -> bytes:
    """One bit for each place of a hash table of one to two places a shingle: whether an odd number of shingles fell there."""
    places = max(64, 1 << (len(shingles) - 1).bit_length())
    at = ((shingles >> np.uint64(20)) % np.uint64(places)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


class ParitySketches:
    """Sets by their parities, a sixty-fourth to a thirty-second of their size. Each place that differs holds a shingle of only one
    of the two sets, so these places never outnumber the shingles that differ."""

    def __init__(self, packed: list[bytes]):
        raw = [np.frombuffer(x, "<u8") for x in packed]
        self.width = np.array([len(x) for x in raw], np.int64)
        self.place, self.table = np.zeros(len(raw), np.int64), {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.place[own] = np.arange(len(own))
            self.table[width] = np.concatenate([raw[i] for i in own.tolist()]).reshape(-1, width)

    @staticmethod
    def _folded(bits: np.ndarray, width: int) -> np.ndarray:
        while bits.shape[1] > width:
            half = bits.shape[1] // 2
            bits = bits[:, :half] ^ bits[:, half:]
        return bits

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places that differ between the sets x and y, pair by pair; the longer sketch is folded to the shorter one's places."""
        out = np.zeros(len(x), np.int64)
        kind = self.width[x] << 32 | self.width[y]
        for both in np.unique(kind).tolist():
            wide, other = both >> 32, both & 0xFFFFFFFF
            of, step = np.flatnonzero(kind == both), max(1, HELD_WORDS // max(wide, other))
            for at in (of[i : i + step] for i in range(0, len(of), step)):
                a, b = self.table[wide][self.place[x[at]]], self.table[other][self.place[y[at]]]
                least = min(wide, other)
                out[at] = np.bitwise_count(self._folded(a, least) ^ self._folded(b, least)).sum(axis=1, dtype=np.int64)
        return out


def set_keys(docs: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``id, n_shingles, key, sketch``: the key is 128 bits of the set, null for an empty one, the sketch its parities."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, 1, SLICE):
            sets = shingle_sets(part.column(1), size)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            counts = pa.array([len(s) for s in sets], pa.int64())
            sketches = pa.array([parities(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), counts, pa.array(keys, pa.binary()), sketches], ["id", "n_shingles", "key", "sketch"]
            )

    frame = B.keyed_texts(docs, id_column, text_column)
    return frame.mapInArrow(run, B.result_schema(frame, "id", "n_shingles long, key binary, sketch binary"))


def shared_signatures(docs: DataFrame, size: int, bands: SizeBands, tasks: int, text_column: str) -> DataFrame:
    """``bucket, key``: sets that share a signature with a different set.

    A slice of texts sends one row per reducing task: its distinct sets' keys, how many signatures each has there, and SENT bytes
    of each signature.
    Equal sets of a slice are sent once, so a group of copies costs one entry per slice, however large it is.
    """

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, 0, SLICE):
            sets = {xxhash.xxh3_128_digest(s.tobytes()): s for s in shingle_sets(part.column(0), size) if len(s)}
            keys = np.frombuffer(b"".join(sets), "V16")
            number, value = signatures(list(sets.values()), bands)
            target = (value % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            number, value, ends = number[order], value[order], np.searchsorted(target[order], np.arange(tasks + 1))
            rows = []
            for task in range(tasks):
                own = slice(ends[task], ends[task + 1])
                if ends[task + 1] > ends[task]:
                    held, counts = np.unique(number[own], return_counts=True)
                    short = (value[own] >> np.uint64(64 - 8 * SENT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
                    rows.append((task, keys[held].tobytes(), counts.astype("<u4").tobytes(), short.tobytes()))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["task", "keys", "counts", "signatures"])

    def meet(table: pa.Table) -> pa.Table:
        keys, counts, values = (b"".join(table.column(c).to_pylist()) for c in ("keys", "counts", "signatures"))
        value = np.zeros((len(values) // SENT, 8), np.uint8)
        value[:, :SENT] = np.frombuffer(values, np.uint8).reshape(-1, SENT)
        value = value.view("<u8").reshape(-1)
        distinct, code = np.unique(np.frombuffer(keys, "V16"), return_inverse=True)
        owner = np.repeat(code, np.frombuffer(counts, "<u4"))
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        _, first, sizes = np.unique(value, return_index=True, return_counts=True)
        shared = sizes > 1
        # buckets of this task with the same members are one bucket
        mark = np.add.reduceat(spread(owner.astype(np.uint64) + _MULT), first) if len(first) else np.zeros(0, np.uint64)
        _, pick = np.unique(np.where(shared, mark, 0), return_index=True)
        pick = pick[shared[pick]]
        each = sizes[pick]
        ends = np.cumsum(each)
        at = np.repeat(first[pick] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        members = [k.tobytes() for k in distinct[owner[at]]]
        bucket = value[at].astype(np.int64) * tasks + table.column("task")[0].as_py()
        return pa.table({"bucket": pa.array(bucket), "key": pa.array(members, pa.binary())})

    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    sent = texts.mapInArrow(send, "task int, keys binary, counts binary, signatures binary")
    return sent.groupBy("task").applyInArrow(meet, "bucket long, key binary")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Counts of shingles by hash, up to 255 each."""
    counts = np.bincount((shingles >> np.uint64(33)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.int16)


def alike(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have 100 * intersection >= percent * union with the one; all are sorted and not empty."""
    sizes = np.array([len(o) for o in others], np.int64)
    both = np.zeros(len(others), np.int64)
    starts = np.unique(np.cumsum(sizes) // AT_ONCE, return_index=True)[1].tolist()
    for start, stop in zip(starts, [*starts[1:], len(others)]):
        held = np.concatenate(others[start:stop])
        hit = one[np.minimum(np.searchsorted(one, held), len(one) - 1)] == held
        both[start:stop] = np.add.reduceat(hit, np.cumsum(sizes[start:stop]) - sizes[start:stop], dtype=np.int64)
    return 100 * both >= percent * (len(one) + sizes - both)


def with_a_partner(
    number: np.ndarray, member: np.ndarray, root: np.ndarray, part: np.ndarray, inside: np.ndarray, size: np.ndarray,
    sketches: ParitySketches, percent: int,
) -> np.ndarray:
    """Which rows have a row of another root in their block (``number``) that may be similar by sizes and parities.

    Sets of m and n shingles that differ in d share (m + n - d) / 2, and d is at least the difference of their sizes and the
    number of parities that differ, so no row of a similar pair is left out.
    """
    hit = np.zeros(len(number), bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        open_ = (root[i] != root[j]) & ((inside[i] & inside[j]) | (part[i] != part[j])) & ~(hit[i] & hit[j])
        i, j = i[open_], j[open_]
        m, n = size[member[i]], size[member[j]]
        open_ = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
        i, j, total = i[open_], j[open_], (m + n)[open_]
        apart = sketches.apart(member[i], member[j])
        good = 100 * (total - apart) >= percent * (total + apart)
        hit[i[good]] = hit[j[good]] = True

    order = np.lexsort((member, number))
    starts = np.flatnonzero(np.diff(number[order], prepend=number[order[:1]] - 1)) if len(order) else np.zeros(0, np.int64)
    count = np.diff(starts, append=len(order))
    end = np.repeat(starts + count, count)
    at, step = np.flatnonzero(np.repeat(count <= LEAF, count)), 1
    while len(at):  # the pairs of all small blocks, by their distance in the block
        at = at[at + step < end[at]]
        meet(order[at], order[at + step])
        step += 1
    for first, n in zip(starts[count > LEAF].tolist(), count[count > LEAF].tolist()):
        own = order[first : first + n]
        _, code, held = np.unique(root[own], return_inverse=True, return_counts=True)
        # a pair of two roots has an end outside the most frequent one
        few = 2 * held.max() > n
        for x in own[code != held.argmax()].tolist() if few else own.tolist():
            if not hit[x]:
                meet(np.full(n, x), own)
            elif few and not hit[own].all():
                rest = own[~hit[own]]
                meet(np.full(len(rest), x), rest)
    return hit


def _dealt(members: DataFrame, weight: Column, task_bytes: int, most_rows: int | None = None) -> DataFrame:
    """``task, bucket, block, key, root, part, inside`` for buckets of more than one component (``root``).

    Units of some ``task_bytes`` stay together: all buckets with the same least component, as they share most members, or one
    bucket where these are too many (or have more than ``most_rows`` rows). A larger bucket is dealt to parts by hash, and each two
    parts of it are a block of their own, so every pair of the bucket meets somewhere and no task holds more than two parts.
    """
    spans = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.sum(weight).alias("bytes"))
    spans = cut(spans.where("least < most").select("bucket", "least", "bytes"))
    mixed = cut(members.join(spans, "bucket"))
    each = mixed.groupBy("least", "key").agg(F.first(weight).alias("weight"), F.count("*").alias("rows"))
    units = cut(each.groupBy("least").agg(F.sum("weight").alias("unit_bytes"), F.sum("rows").alias("rows")))
    total = units.agg(F.sum("unit_bytes")).first()[0] or 0
    tasks = max(16, math.ceil(total / task_bytes))
    fits = F.col("unit_bytes") <= task_bytes
    small = units.where(fits if most_rows is None else fits & (F.col("rows") <= most_rows)).select("least", F.lit(True).alias("whole"))
    laid = mixed.join(small, "least", "left")
    laid = laid.withColumn("parts", F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("bytes") / task_bytes)).cast("int"))
    laid = laid.withColumn("unit", F.when(F.col("whole"), F.xxhash64("least")).otherwise(F.xxhash64("bucket")))
    laid = laid.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    laid = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = [F.least("part", "other"), F.greatest("part", "other")]
    return cut(laid.select(
        F.pmod(F.xxhash64("unit", *ends), F.lit(tasks)).alias("task"), "bucket", F.xxhash64("bucket", *ends).alias("block"), "key", "root",
        "part", (F.col("part") == F.col("other")).alias("inside"),
    ))


def likely_members(members: DataFrame, sketches: DataFrame, percent: int, task_bytes: int = SKETCH_BYTES) -> DataFrame:
    """The rows of ``bucket, key, root, n`` that may be similar to one of another root in their bucket, by their parities.

    Many sets only share a signature of one or two frequent shingles. They are told apart here, by a fiftieth of their bytes,
    before whole sets are sent to the tasks that verify.
    """
    laid = _dealt(members, F.col("n") / 4 + 200, task_bytes, UNIT_ROWS)
    wanted = laid.select(F.col("task").alias("at"), F.col("key").alias("name")).distinct()
    held = wanted.join(sketches.select(F.col("key").alias("name"), "n", "sketch"), "name")

    def choose(rows: pa.Table, held: pa.Table) -> pa.Table:
        at = {key: i for i, key in enumerate(held.column("name").to_pylist())}
        member = np.array([at[key] for key in rows.column("key").to_pylist()], np.int64)
        root = np.unique(np.frombuffer(b"".join(rows.column("root").to_pylist()), "V16"), return_inverse=True)[1]
        size = held.column("n").to_numpy()
        number, part, inside = (rows.column(c).to_numpy() for c in ("block", "part", "inside"))
        hit = with_a_partner(number, member, root, part, inside, size, ParitySketches(held.column("sketch").to_pylist()), percent)
        chosen = rows.select(["bucket", "key", "root"]).append_column("n", pa.array(size[member], pa.int64()))
        return chosen.filter(pa.array(hit))

    near = laid.groupBy("task").cogroup(held.groupBy("at")).applyInArrow(choose, "bucket long, key binary, root binary, n long")
    return near.dropDuplicates(["bucket", "key"])  # a member of a bucket in several blocks


def cross_links(members: DataFrame, sets: DataFrame, percent: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Links ``a, b`` between components (``root``) of ``bucket, key, root, n`` that join what any similar pair of a bucket joins.

    A task holds whole sets, each once.
    """
    laid = _dealt(members, F.col("n") * 8 + 200, task_bytes)
    wanted = laid.select(F.col("task").alias("at"), F.col("key").alias("name")).distinct()
    held = wanted.join(sets.select(F.col("key").alias("name"), "shingles"), "name")

    def verify(rows: pa.Table, held: pa.Table) -> pa.Table:
        at = {key: i for i, key in enumerate(held.column("name").to_pylist())}
        own = [np.frombuffer(s.as_buffer(), np.uint64) for s in held.column("shingles")]
        size = np.array([len(s) for s in own], np.int64)
        counts = np.array([sketch(s) for s in own], np.int16).reshape(-1, SKETCH)
        member = np.array([at[key] for key in rows.column("key").to_pylist()], np.int64)
        names, root = np.unique(np.frombuffer(b"".join(rows.column("root").to_pylist()), "V16"), return_inverse=True)
        root_of = np.zeros(len(own), np.int64)
        root_of[member] = root
        tree, tested, out = np.arange(len(names)), set(), []

        def meet(x: int, among: np.ndarray) -> None:
            """Verify one set with those of others that sketches allow, the nearest of each tree first, until all have failed or
            are one tree with it. Sets of m and n shingles that differ in d share (m + n - d) / 2, and d is at least the sum of
            the differences of their counts, so no similar pair is ruled out."""
            apart = np.maximum(np.abs(counts[among] - counts[x]).sum(axis=1, dtype=np.int64), np.abs(size[among] - size[x]))
            total = size[among] + size[x]
            open_ = np.flatnonzero(100 * (total - apart) >= percent * (total + apart))
            among = among[open_[np.argsort(apart[open_] / total[open_], kind="stable")]]
            among = np.array([y for y in among.tolist() if (min(x, y), max(x, y)) not in tested], np.int64)
            while len(among):
                nearest = np.unique(tree[root_of[among]], return_index=True)[1]
                good = alike(own[x], [own[y] for y in among[nearest].tolist()], percent)
                for y, linked in zip(among[nearest].tolist(), good.tolist()):
                    if linked:
                        out.append((names[root_of[x]].tobytes(), names[root_of[y]].tobytes()))
                        tree[tree == tree[root_of[y]]] = tree[root_of[x]]
                    else:
                        tested.add((min(x, y), max(x, y)))
                among = np.delete(among, nearest)
                among = among[tree[root_of[among]] != tree[root_of[x]]]
            if len(tested) > TESTED:
                tested.clear()

        number = rows.column("block").to_numpy()
        part, inside = rows.column("part").to_numpy(), rows.column("inside").to_numpy()
        order = np.lexsort((member, number))
        for held_by in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            of, p, whole = member[held_by], part[held_by], inside[held_by]
            now = tree[root_of[of]]
            names_now, sizes_now = np.unique(now, return_counts=True)
            # a pair of two trees has an end outside the largest one
            waiting = now != names_now[sizes_now.argmax()] if len(names_now) > 1 else np.zeros(len(of), bool)
            done = np.zeros(len(of), bool)
            for x in np.flatnonzero(waiting).tolist():
                done[x] = True
                meets = ~done & (tree[root_of[of]] != tree[root_of[of[x]]]) & ((whole & whole[x]) | (p != p[x]))
                if meets.any():
                    meet(int(of[x]), of[meets])
        columns = zip(*out) if out else ((), ())
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return laid.groupBy("task").cogroup(held.groupBy("at")).applyInArrow(verify, "a binary, b binary")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of keys with 100 * intersection >= percent * union, counted on the whole sets.

    An ``a`` may stand for a large share of all pairs: they choose one of SALTS copies of its set by the hash of ``b``.
    """
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "salt").distinct().join(left, "a")

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and bool(alike(x, [y], percent)[0]))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = salted.join(right, "b").join(heads, ["a", "salt"]).select("a", "b", "sa", "sb")
    return joined.mapInArrow(check, "a binary, b binary")


def link(docs: DataFrame, size: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_shingles, component_id``: the smallest id that links reach from each row, itself included.

    Rows with equal sets are one set from the start (their links are certain), so copies are never expanded into pairs. Sets
    that share a signature form buckets; a member that by its parities is similar to no other one leaves its bucket, and without
    buckets no set is built. First every set meets the least one of one of its buckets. Buckets that then hold more
    than one component go to tasks with their sets, which verify pairs of different components and send on one link for each two
    components they join: rows grow with members, not with their pairs. A pair inside a component needs no test, as its outcome
    changes nothing.
    Every tested pair is verified on whole sets, so components are those of all links, none lost, none false.
    Null and empty texts have no shingles and stand alone. Null ids join components but never name one unless all are null;
    repeated rows share a component; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    spark = docs.sparkSession
    folder = scratch_path(spark, "jaccard")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    rows = kept(set_keys(docs, size, id_column, text_column), "rows")
    total, largest = rows.agg(F.sum("n_shingles"), F.max("n_shingles")).first()
    bands = SizeBands(percent, max(1, largest or 0))
    tasks = max(1, math.ceil((total or 0) * 2 / 3 / SIGNATURES))
    classes = kept(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id")), "classes")
    found = kept(shared_signatures(docs, size, bands, tasks, text_column), "found")
    # the same members in buckets of several tasks: keep one bucket
    marks = found.groupBy("bucket").agg(F.min("key").alias("least"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n"))
    marks = kept(marks.groupBy("least", "mark", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "marks")
    members = found.join(marks, "bucket")
    sketches = rows.join(found.select("key").distinct(), "key", "left_semi").groupBy("key")
    sketches = kept(sketches.agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    alone = members.join(sketches.select("key", "n"), "key").select("bucket", "key", F.col("key").alias("root"), "n")
    likely = kept(likely_members(kept(alone, "members"), sketches, percent).select("bucket", "key"), "likely")
    sets = kept(_sets_of(docs, likely.select("key").distinct(), rows, size, id_column, text_column), "sets")

    leasts = kept(likely.groupBy("bucket").agg(F.min("key").alias("least")), "leasts")
    pairs = likely.join(leasts, "bucket").where("key != least").groupBy(F.col("key").alias("b")).agg(F.min("least").alias("a")).select("a", "b")
    roots = sets.select(F.col("key").alias("node"), F.col("key").alias("root"), "n")
    roots = kept(_merged(roots, kept(similar(pairs, sets, percent), "first_links")), "first_roots")
    at = kept(likely.join(roots.withColumnRenamed("node", "key"), "key").select("bucket", "key", "root", "n"), "at")
    at = kept(likely_members(at, sketches, percent), "likely_at")
    links = kept(cross_links(at, sets, percent), "links")
    roots = kept(_merged(roots, links), "roots").select("node", "root")

    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = kept(named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component_id")), "least")
    of_key = kept(named.join(least, "root").select("key", "component_id"), "of_key")
    return rows.join(of_key, "key", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root, n`` with the roots that links between them reach."""
    new = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return roots.join(new, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"), "n")


def _sets_of(docs: DataFrame, keys: DataFrame, rows: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``key, n, shingles`` of the given keys, from the text of one row of each class (the one with the least id)."""
    wanted = cut(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id")))
    frame = B.keyed_texts(docs, id_column, text_column)
    chosen = wanted.select("id", F.col("key").alias("wanted"))
    chosen = F.broadcast(chosen) if wanted.count() <= SMALL else chosen
    joined = frame.join(chosen, frame["id"].eqNullSafe(chosen["id"])).select(chosen["wanted"], "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.slices(parts, 1):
            keys_, sizes, out = [], [], []
            for key, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), size)):
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key:  # rows with one id may differ in text
                    keys_.append(key)
                    sizes.append(len(s))
                    out.append(s.tobytes())
            columns = [pa.array(keys_, pa.binary()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "shingles"])

    return joined.mapInArrow(run, "key binary, n long, shingles binary").dropDuplicates(["key"])
