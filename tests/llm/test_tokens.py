import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from texts import HARD
from tokenizers import Tokenizer

from cloakwork.llm import bpe, packing, stages, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    made = ["".join(draw.choice("ab \n\t.,'1é中") for _ in range(draw.randint(0, 400))) for _ in range(150)]
    return [*enumerate([*HARD, *made]), (None, "no id"), (3, "an id again")]


def test_encode_and_decode_as_the_library(documents, rows, byte_library):
    out = bpe.decode(bpe.encode(documents(rows), BYTE), BYTE).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["token_ids"]), r["text"]) for r in out)
    ids = [byte_library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = sorted((i is None, i or 0, x, byte_library.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids))
    assert got == want


def test_segment_tree_of_long_pieces_as_of_short_ones(byte_library):
    with open(BYTE, "rb") as file:
        model = bpe.ByteBpe(file.read())
    draw = random.Random(5)
    for size in (2, 3, 5, 8, 17, 63, 64, 65, 1000, 5000):
        token = "".join(draw.choice("abcth") for _ in range(size)).encode()
        want = byte_library.encode(token.decode(), add_special_tokens=False).ids
        assert np.frombuffer(model.merge_alone(token), "<u4").tolist() == want
        if size <= 65:
            assert np.frombuffer(model.merge_together([token], 128)[0], "<u4").tolist() == want


def test_decode_of_broken_and_unknown_ids(spark, byte_library):
    frame = spark.createDataFrame([(1, [128, 257, 999_999]), (2, None), (3, [None, 64])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(frame, BYTE).collect()}
    assert got[2] == "" and got[3] == byte_library.decode([64]) and "�" in got[1]


def test_counts_as_the_library(documents, rows):
    library = Tokenizer.from_file(WORD)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(documents(rows), WORD, limit=100).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), k, k > 100) for (i, t), k in zip(rows, n))


@pytest.mark.parametrize("limits", [(1024, 64, None), (16, 3, None), (16, 5, 9), (1, 1, None)])
def test_packing_keeps_every_id_within_all_limits(documents, rows, byte_library, limits):
    tokens, segments, loss = limits
    rows = rows if tokens > 1 else rows[:20]
    plain = [r for r in rows if r[0] is not None][:-1]
    out = packing.pack(documents(plain), BYTE, tokens, segments, loss, window=16).collect()
    ids = {i: [*byte_library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in plain}
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= tokens and len(parts) <= segments and sum(p["loss_tokens"] for p in parts) <= (loss or tokens)


def test_packing_wastes_little(documents):
    draw = random.Random(1)
    rows = [(i, "word " * draw.randint(1, 900)) for i in range(400)]
    out = packing.pack(documents(rows).coalesce(1), BYTE).collect()
    used, sequences = sum(r["length"] for r in out), len({r["sequence_id"] for r in out})
    assert used > 0.98 * 1024 * sequences


def test_repeated_rows_null_ids_and_empty_tables(documents):
    twice = packing.pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), BYTE).collect()
    assert sorted(r["doc_id"] or 0 for r in twice) == [0, 1, 1]
    empty = documents([])
    for frame in (packing.pack(empty, BYTE), bpe.encode(empty, BYTE), bpe.decode(bpe.encode(empty, BYTE), BYTE), token_counts.count_tokens(empty, WORD)):
        assert frame.count() == 0 and "doc_id" in frame.columns


def test_digest_contract(documents):
    from pyspark.sql import functions as F

    row = bpe.encode(documents([(1, "hello world")]), BYTE).select(F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(",".join(map(str, Tokenizer.from_file(BYTE).encode("hello world").ids)).encode()).hexdigest()


def test_packing_encodes_as_much_at_once_as_it_is_told(documents, monkeypatch):
    """In the pipeline, slices of 8 MB beside what earlier stages left took an executor beyond its memory."""
    frame = documents([(i, f"word{i} " * 200) for i in range(60)]).coalesce(1)
    want = packing.pack(frame, BYTE).select("doc_id", "start", "length", "ids_crc32").collect()
    got = packing.pack(frame, BYTE, slice_bytes=4096).select("doc_id", "start", "length", "ids_crc32").collect()
    spans = lambda rows: {d: sum(r["length"] for r in rows if r["doc_id"] == d) for d in range(60)}
    assert spans(got) == spans(want)
    seen = []
    monkeypatch.setattr(packing, "pack", lambda docs, vocabulary, **options: seen.append(options))
    stages.pack_rest(frame.sparkSession, frame, "")
    assert seen[0]["slice_bytes"] <= 1 << 20
