"""Packing of token sequences as vector bin packing: tokens, segments and loss-bearing tokens are limited together."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

from cloakwork.llm import batches as B


class PieceEncoder(B.PieceIds):
    """Ids by the library, which encodes each new piece of text once per worker."""

    def __init__(self, definition: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a blank
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith("Ġ")

    def learn(self, new: list[str], blank: bool) -> None:
        alone = [w for w in new if not blank or not w or w[0].isspace()]  # here a blank may be a token of its own
        for pack in B.packs([" " + w for w in alone] if blank else alone):
            for piece, e in zip(pack, self.tokenizer.encode_batch_fast(pack, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4").tobytes()
                if blank:
                    self.blank[piece[1:]] = ids
                else:
                    self.plain[piece] = ids
        for pack in B.packs([w for w in new if w and not w[0].isspace()] if blank else []):
            # the pieces joined: a token with a leading blank begins the next one
            ids = np.array(self.tokenizer.encode(" " + " ".join(pack), add_special_tokens=False).ids, "<u4")
            begins = np.flatnonzero(self.starts[ids])
            raw, ends = ids.tobytes(), [*(4 * begins[1:]).tolist(), 4 * len(ids)]
            for word, a, b in zip(pack, (4 * begins).tolist(), ends, strict=True):
                self.blank[word] = raw[a:b]


def encoder_in_worker(definition: Broadcast) -> PieceEncoder:
    """Found by its module, so what it has learned outlives a task."""
    return B.in_worker(("packing", hash(definition.value)), lambda: PieceEncoder(definition.value))


@dataclass
class Piece:
    key: object
    start: int
    ids: bytes  # little-endian 32-bit
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        """The first token of a document has nothing before it, so nothing is learnt from it."""
        return self.length - (self.start == 0)


def dot_product_bins(pieces: list[Piece], limits: tuple[int, int, int]) -> list[list[Piece]]:
    """Fill one bin at a time with the fitting piece whose demand has the largest dot product with the room that is left.

    Demands and room are (tokens, segments, loss-bearing tokens) as shares of the limits. Pieces of equal demand form one
    kind, so a choice costs as many steps as there are kinds (about two per length), not pieces.
    """
    kinds: dict[tuple[int, int, int], deque[Piece]] = defaultdict(deque)
    for piece in pieces:
        kinds[piece.length, 1, piece.loss].append(piece)
    order = sorted(kinds, reverse=True)
    demand = np.array(order, float).reshape(-1, 3)
    share = demand / np.array(limits, float)
    left = np.array([len(kinds[k]) for k in order])
    bins: list[list[Piece]] = []
    while left.any():
        room, chosen = np.array(limits, float), []
        while True:
            fits = (left > 0) & (demand <= room).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, share @ (room / np.array(limits, float)), -1)))
            chosen.append(kinds[order[best]].popleft())
            left[best] -= 1
            room -= demand[best]
        bins.append(chosen)
    return bins


def cut_to_fill(pieces: list[Piece], limits: tuple[int, int, int]) -> list[list[Piece]]:
    """Lay pieces end to end and cut them at the token limit; a sequence also ends at the other limits."""
    out: list[list[Piece]] = []
    now: list[Piece] = []
    room = list(limits)
    queue = deque(pieces)
    while queue:
        piece = queue.popleft()
        take = min(piece.length, room[0], room[2] + (piece.start == 0))
        if take <= 0 or room[1] <= 0:
            out.append(now)
            now, room = [], list(limits)
            queue.appendleft(piece)
            continue
        head = Piece(piece.key, piece.start, piece.ids[: 4 * take], piece.doc_tokens)
        now.append(head)
        room = [room[0] - head.length, room[1] - 1, room[2] - head.loss]
        if take < piece.length:
            queue.appendleft(Piece(piece.key, piece.start + take, piece.ids[4 * take :], piece.doc_tokens))
    return out + [now] if now else out


def pack(
    docs: DataFrame, vocabulary: str, max_tokens: int = 1024, max_segments: int = 64, max_loss_tokens: int | None = None,
    end_id: int = 0, window: int = 8192, slack: float = 0.01, id_column: str = "doc_id", text_column: str = "text",
    slice_bytes: int = B.SLICE_BYTES,
) -> DataFrame:
    """Pieces of every document with their sequence and place in it; no id is lost, repeated or padded inside a sequence.

    A document's ids, with ``end_id`` behind them, are cut into pieces that fill a sequence alone and one remainder. Each task
    packs remainders in windows by the dot-product heuristic; what stands in sequences with more than ``slack`` of room goes
    on to the next window, and at the end of the task is cut to fill. So a task leaves one sequence with room or a few, no
    shuffle is needed, and memory is one window and ``slice_bytes`` of text at once. A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
    ``max_loss_tokens`` tokens that bear a loss (default: no limit of its own).
    Null and empty texts are the end id alone; repeated rows and null ids are packed as documents of their own; an empty
    table gives no rows; other columns are ignored, whatever their names. ``sequence_id`` holds the task's number and a count.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss_tokens is None else max_loss_tokens)
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    whole = min(limits[0], limits[2])
    with open(vocabulary, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    schema = B.result_schema(docs, id_column, fields)
    names, ender = [f.name for f in schema.fields], np.array([end_id], "<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_in_worker(definition)
        number = TaskContext.get().partitionId() << 36
        waiting: list[Piece] = []
        key_type = None

        def rows(bins: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in names]
            for chosen in bins:
                place = 0
                for p in chosen:
                    for column, value in zip(
                        columns, (p.key, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, number, place, p.loss)
                    ):
                        column.append(value)
                    place += p.length
                number += 1
            types = [key_type, *[pa.int64()] * (len(names) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def settle(last: bool) -> list[list[Piece]]:
            nonlocal waiting
            bins = dot_product_bins(waiting, limits)
            full = [b for b in bins if sum(p.length for p in b) >= (1 - slack) * max_tokens]
            rest = [p for b in bins if sum(p.length for p in b) < (1 - slack) * max_tokens for p in b]
            if last or len(rest) >= window:
                full, rest = full + cut_to_fill(rest, limits), []
            waiting = rest
            return full

        for part in B.slices(parts, 1, slice_bytes):
            key_type = part.column(0).type
            bins = []
            ids_of, offsets = encoder.encode(part.column(1))
            raw, cuts = ids_of.tobytes(), (4 * offsets).tolist()
            for key, a, b in zip(part.column(0).to_pylist(), cuts, cuts[1:]):
                ids = raw[a:b] + ender
                total, start = len(ids) // 4, 0
                while total - start >= whole:
                    bins.append([Piece(key, start, ids[4 * start : 4 * (start + whole)], total)])
                    start += whole
                if start < total:
                    waiting.append(Piece(key, start, ids[4 * start :], total))
            if len(waiting) >= window:
                bins += settle(last=False)
            if bins:
                yield rows(bins)
        if waiting:
            yield rows(settle(last=True))

    return B.keyed_texts(docs, id_column, text_column).mapInArrow(run, schema)
