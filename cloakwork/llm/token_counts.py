"""Token counts of whole texts by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from cloakwork.llm import batches as B

_COUNTERS: dict[int, "Counter"] = {}


class Counter:
    """Counts of white-space-free words, kept in the worker; the library encodes the words that are new."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def count(self, texts: pa.Array) -> np.ndarray:
        distinct, codes, offsets = B.word_codes(texts)
        names = distinct.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > B.CACHE_ENTRIES:
            self.known.clear()
        for pack in B.packs([n for n in names if n not in self.known]):
            self.known.update(zip(pack, map(len, self.tokenizer.encode_batch_fast(pack, add_special_tokens=False))))
        each = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return B.sums(each[codes], offsets)


def counter_in_worker(definition: Broadcast) -> Counter:
    """Found by its module, so what it has learned outlives a task."""
    key = hash(definition.value)
    return _COUNTERS.get(key) or _COUNTERS.setdefault(key, Counter(definition.value))


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column, n_bytes, n_tokens, over_limit`` of every row; only lengths leave the Arrow function.

    For tokenizer files that drop white space (a token never holds it), so a text may be cut at any white space: long texts
    are split there, and batches for the library hold about equal numbers of characters. Slices of rows are balanced by bytes.
    A null text counts as empty (0 tokens); repeated rows and null ids are counted like others; an empty table gives no rows;
    other columns are ignored, whatever their names. ``vocabulary`` is read on the driver and sent to the tasks (about 2 MB).
    """
    with open(vocabulary, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_in_worker(definition)
        for part in B.slices(parts, 1):
            tokens = pa.array(counter.count(part.column(1)))
            size = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), size, tokens, pc.greater(tokens, limit)], [id_column, "n_bytes", "n_tokens", "over_limit"]
            )

    schema = B.result_schema(docs, id_column, "n_bytes long, n_tokens long, over_limit boolean")
    return B.keyed_texts(docs, id_column, text_column).mapInArrow(run, schema)
