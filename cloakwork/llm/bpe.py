"""Byte-level BPE by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import batches as B

NONE = np.iinfo(np.int64).max
IDS_TOGETHER = 1 << 20  # ids decoded at once, or one list
LONGEST_TOGETHER = 64  # bytes; longer pieces are merged one at a time
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MODELS: dict[int, "ByteBpe"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(moved.get(b, b)) for b in range(256)]


class ByteBpe(B.PieceIds):
    """Vocabulary and merges of one file, and the ids of the pieces seen in this worker."""

    most = 600_000  # a worker that decodes stands beside the one that encodes

    def __init__(self, definition: bytes):
        super().__init__()
        data = json.loads(definition)
        vocabulary, symbols = data["model"]["vocab"], byte_symbols()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)  # by rank
        pairs = left * self.size + right
        self.rank_order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.rank_order]
        self.byte_ids = np.array([vocabulary[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.split_pattern = regex.compile(SPLIT)
        byte_of = {s: b for b, s in enumerate(symbols)}
        token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}
        token_bytes |= {i: t.encode("utf-8") for t, i in self.special.items()}
        self.unknown = max(token_bytes) + 1  # stands for ids that add nothing
        self.token_bytes = pa.array([token_bytes.get(i, b"") for i in range(self.unknown + 1)], pa.binary())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where the pair has no merge or a side is missing (negative)."""
        pair = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank_order[at], NONE)

    def merge_together(self, tokens: list[bytes], width: int) -> list[bytes]:
        """Merge many short byte strings at once; row r of ``tree`` is the segment tree of string r.

        A leaf holds rank * width + position of the pair that starts there, an inner node the least of its two sons, so the
        root is the leftmost pair of lowest rank. A merge changes three leaves: its own, the pair before, the pair swallowed.
        """
        n = len(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        flat = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        place = np.arange(width)
        sym = np.full((n, width), -1, np.int64)
        sym[place < lengths[:, None]] = flat
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        first = self.ranks(sym[:, :-1], sym[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(first == NONE, NONE, first * width + place[:-1])
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while rows.size:
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            sym[rows, at] = self.made[rank]
            sym[rows, gone] = -1
            then = after[rows, gone]
            after[rows, at] = then
            inner = then < width
            before[rows[inner], then[inner]] = at[inner]
            ahead = before[rows, at]
            has_ahead = ahead >= 0
            back = np.where(has_ahead, ahead, 0)
            own = self.ranks(sym[rows, at], np.where(inner, sym[rows, np.where(inner, then, 0)], -1))
            prior = self.ranks(np.where(has_ahead, sym[rows, back], -1), sym[rows, at])
            tree[rows, width + gone] = NONE
            tree[rows, width + at] = np.where(own == NONE, NONE, own * width + at)
            tree[rows[has_ahead], width + ahead[has_ahead]] = np.where(prior == NONE, NONE, prior * width + ahead)[has_ahead]
            for leaf in (gone, at, back):
                node = (width + leaf) >> 1
                while node[0]:  # all leaves are equally deep
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != NONE]
        kept = sym >= 0
        ends = 4 * np.cumsum(kept.sum(axis=1))
        raw = sym[kept].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_alone(self, token: bytes) -> bytes:
        """The same tree for one long byte string, in plain lists."""
        ids = self.byte_ids[np.frombuffer(token, np.uint8)]
        n = len(ids)
        width = 1 << max(1, (n - 1).bit_length())
        first = self.ranks(ids[:-1], ids[1:])
        tree = [NONE] * (2 * width)
        tree[width : width + n - 1] = [r * width + i if r != NONE else NONE for i, r in enumerate(first.tolist())]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        sym, after, before = ids.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        rank_of = self.rank_of

        def put(place: int, value: int) -> None:
            node = width + place
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] != NONE:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            sym[at], sym[gone] = int(self.made[rank]), -1
            then = after[at] = after[gone]
            put(gone, NONE)
            own = rank_of(sym[at], sym[then]) if then < n else None
            put(at, NONE if own is None else own * width + at)
            if then < n:
                before[then] = at
            ahead = before[at]
            if ahead >= 0:
                prior = rank_of(sym[ahead], sym[at])
                put(ahead, NONE if prior is None else prior * width + ahead)
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def rank_of(self, left: int, right: int) -> int | None:
        rank = self.ranks(np.array([left]), np.array([right]))[0]
        return None if rank == NONE else int(rank)

    def merge(self, tokens: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for token in tokens:
            if len(token) == 1:
                out[token] = int(self.byte_ids[token[0]]).to_bytes(4, "little")
            elif len(token) > LONGEST_TOGETHER:
                out[token] = self.merge_alone(token)
            else:
                by_width.setdefault(max(4, 1 << (len(token) - 1).bit_length()), []).append(token)
        for width, group in by_width.items():
            for i in range(0, len(group), 1 << 15):
                out.update(zip(group[i : i + (1 << 15)], self.merge_together(group[i : i + (1 << 15)], width)))
        return out

    def learn(self, new: list[str], blank: bool) -> None:
        """Special strings are single tokens, all else is split and merged."""
        known = self.blank if blank else self.plain
        for start in range(0, len(new), 1 << 16):
            pack = new[start : start + (1 << 16)]
            split = [self.split(" " + p if blank else p) for p in pack]
            ids = self.merge(list({p for found in split for p in found if isinstance(p, bytes)}))
            for piece, found in zip(pack, split):
                known[piece] = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else ids[p] for p in found])

    def split(self, text: str) -> list[bytes | int]:
        """Pre-tokens as UTF-8, special strings as their id."""
        found: list[bytes | int] = []
        start = 0
        for hit in self.special_pattern.finditer(text) if any(s in text for s in self.special) else ():
            found += [t.encode("utf-8") for t in self.split_pattern.findall(text[start : hit.start()])]
            found.append(self.special[hit[0]])
            start = hit.end()
        return found + [t.encode("utf-8") for t in self.split_pattern.findall(text[start:] if start else text)]

    def decode(self, lists: pa.ListArray) -> pa.StringArray:
        """The text of each list: bytes of all its tokens, read as UTF-8; unknown and null ids add nothing.

        All bytes are gathered at once, and the texts are views of them. Only where a text has a broken sequence is each read by
        itself, with U+FFFD in its place.
        """
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < self.unknown), ids, self.unknown)
        gathered = self.token_bytes.take(pa.array(ids))
        _, at, data = gathered.buffers()
        data = data or pa.py_buffer(b"")
        bounds = np.concatenate([[0], np.cumsum(lengths_of(lists))])
        at = np.frombuffer(at, np.int32)[bounds] if len(ids) else np.zeros(len(bounds), np.int32)
        texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(np.ascontiguousarray(at)), data)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = memoryview(data)
            return pa.array([str(raw[a:b], "utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())
        return texts


def lengths_of(lists: pa.ListArray) -> np.ndarray:
    """Entries of each list, 0 of a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def model_in_worker(definition: Broadcast) -> ByteBpe:
    key = hash(definition.value)
    return _MODELS.get(key) or _MODELS.setdefault(key, ByteBpe(definition.value))


def _shared(frame: DataFrame, vocabulary: str) -> Broadcast:
    with open(vocabulary, "rb") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, token_ids`` of every row, as the file's own library gives them without added special tokens.

    Texts are cut where white space follows something else (no token spans such a border), and each new piece is split by
    the byte-level pattern and merged by the segment tree; a worker remembers the pieces it has seen. Special strings inside
    texts become their id. Null texts are empty and give an empty list; repeated rows and null ids are encoded like others;
    an empty table gives no rows; other columns are ignored, whatever their names. A whole text is in memory at once.
    """
    definition = _shared(docs, vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_in_worker(definition)
        for part in B.slices(parts, 1):
            ids, offsets = model.encode(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_column, "token_ids"])

    return B.keyed_texts(docs, id_column, text_column).mapInArrow(run, B.result_schema(docs, id_column, "token_ids array<int>"))


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "token_ids") -> DataFrame:
    """``id_column, token_ids, text``: the text that each list of ids stands for, special tokens included.

    A null list decodes to an empty text, a null id inside a list adds nothing.
    """
    definition = _shared(encoded, vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_in_worker(definition)
        for part in parts:
            ends, start = np.cumsum(lengths_of(part.column(1))), 0
            while start < part.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + IDS_TOGETHER, "right")))
                rows, start = part.slice(start, stop - start), stop
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), model.decode(rows.column(1))], [id_column, "token_ids", "text"])

    schema = B.result_schema(encoded, id_column, "token_ids array<int>, text string")
    frame = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("token_ids"))
    return frame.mapInArrow(run, schema)
