"""Whole texts inside Arrow tasks: slices of bounded bytes, and pieces of a text that tokenizers treat one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 8 << 20  # text handled at once in a task; one longer text is a slice of its own
CACHE_ENTRIES = 1_000_000  # pieces a Python worker remembers before it starts anew

_REMEMBERED: dict[object, object] = {}

WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the Unicode property, inside a class
_PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_SPACE_PAIRS = [chr(c) + " " for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices whose texts (column number ``text``) hold at most ``limit`` bytes or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def in_worker(key: object, make: Callable[[], object]) -> object:
    """What this worker remembers under ``key``, from task to task; what it remembered of other work is dropped."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """Drop what this worker remembers of earlier work: workers outlive jobs, and the next one needs the memory."""
    _REMEMBERED.clear()
    pa.default_memory_pool().release_unused()


def codes_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, their numbers in order of appearance in the lists, offset of each list) of a fresh list array."""
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space (0x20, 0x09-0x0D) of each text, as ``codes_of``; null is empty."""
    distinct, codes, offsets = codes_of(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        kept = codes != empty
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return distinct, codes, offsets


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def hashes(strings: pa.Array) -> np.ndarray:
    """64 well-mixed bits of each string (no nulls), eight bytes of all strings at a time; the same in every process."""
    raw = strings.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1] or bytes(8), np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    at, left = bounds[:-1] - bounds[0], np.diff(bounds)
    words = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)))  # from each byte on
    out = _mixed(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo = np.flatnonzero(left)
    at, left = at[todo], left[todo]
    while len(todo):
        short = np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        word = words[at] & (~np.uint64(0) >> (np.uint64(64) - short))
        out[todo] = _mixed((out[todo] ^ word) * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring offsets; 0 where there are none."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])[offsets])


def pieces(text: str) -> list[str]:
    """The text cut wherever white space follows something else."""
    return _PIECE.findall(text)


class PieceIds:
    """Ids of texts, put together from the ids of their pieces, which a worker remembers.

    A token of the byte-level pattern never spans the border between a character that is not white space and white space, so
    each piece between such borders is encoded alike alone and in its text. A text in which no blank follows white space is
    simply cut before each blank; the pieces behind the first are then known by what follows their blank.
    """

    most = CACHE_ENTRIES

    def __init__(self) -> None:
        self.blank: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def learn(self, new: list[str], blank: bool) -> None:
        """Put the ids (little-endian 32-bit) of new pieces into ``blank`` (less their leading blank) or ``plain``."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offset of each text); null is empty."""
        if len(self.blank) + len(self.plain) > self.most:
            self.blank.clear()
            self.plain.clear()
        texts = pc.fill_null(texts, "")
        strings = texts.to_pylist()
        odd = {i: pieces(t) for i, t in enumerate(strings) if any(p in t for p in _SPACE_PAIRS)}
        if odd:
            texts = pa.array(["" if i in odd else t for i, t in enumerate(strings)], pa.string())
        distinct, codes, offsets = codes_of(pc.split_pattern(texts, " "))
        first = offsets[:-1]
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        at_front = {c: names[c] for c in np.unique(codes[first]).tolist()}
        behind = np.ones(len(codes), bool)
        behind[first] = False
        used = np.zeros(len(names), bool)
        used[codes[behind]] = True
        later = [n for n, u in zip(names, used.tolist()) if u]
        for known, wanted, blank in ((self.blank, later, True), (self.plain, {*at_front.values(), *(p for o in odd.values() for p in o)}, False)):
            new = [w for w in wanted if w not in known]
            if new:
                self.learn(new, blank)
        # the table: ids of the later pieces by code, then of the front pieces, then of the odd texts
        parts = [self.blank[n] if u else b"" for n, u in zip(names, used.tolist())]
        front_row = np.zeros(len(names), np.int64)
        for row, (code, name) in enumerate(at_front.items(), len(parts)):
            front_row[code] = row
        parts += [self.plain[n] for n in at_front.values()]
        rows = codes.astype(np.int64)
        rows[first] = front_row[codes[first]]
        for i, cut in odd.items():
            rows[first[i]] = len(parts)
            parts.append(b"".join([self.plain[p] for p in cut]))
        table = np.frombuffer(b"".join(parts), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[rows]
        ends = np.cumsum(each)
        ids = table[np.repeat(starts[rows] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[offsets]


def packs(items: list[str], limit: int = 1 << 16) -> Iterator[list[str]]:
    """Lists of strings of about equal size in characters."""
    pack, size = [], 0
    for item in items:
        pack.append(item)
        size += len(item) + 1
        if size >= limit:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the id and the text, as string; other columns, whatever their names, stay behind."""
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))


def result_schema(docs: DataFrame, id_column: str, fields: str) -> T.StructType:
    """The id column with its type, then ``fields``."""
    key = docs.schema[id_column]
    return T.StructType([T.StructField(id_column, key.dataType, True), *T._parse_datatype_string(fields).fields])
