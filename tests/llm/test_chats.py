import hashlib

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.llm.chat_format import ChatTemplate, format_chats, loss_text, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, n_blocks int"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA)
    out = format_chats(frame).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: r for r in out.collect()}


def test_merges_marks_and_masks(spark):
    rows = [(1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 3, "assistant", ""), (1, 4, "user", None)]
    got = run(spark, rows)[1]
    assert got["formatted"] == (
        "<|im_start|>user<|im_body|>a<|im_next|>b<|im_end|><|im_start|>assistant<|im_body|>c<|im_next|><|im_end|><|im_start|>user<|im_body|><|im_end|>"
    )
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", ""), ("user", "")]
    assert got["loss"] == "c" and got["n_blocks"] == 3
    assert [got["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in got["loss_spans"]] == ["c", ""]


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, 0, "user", "x"), (2, None, "user", "first"), (2, 1, None, "b"), (2, 1, "", "a"), (2, 1, "", "a"), (3, 0, "assistant", "y" * 60_000)]
    got = run(spark, rows)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("user", "first"), ("", "a"), ("", "a"), ("", "b")]
    assert got[None]["loss"] == "" and len(got[3]["loss"]) == 60_000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_body|>", "<|im_next|>", "<", "[", "\\", "s>", "INST]", "a", "\n", "é", "$1"]
TEXT = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<s>\\"]), TEXT), min_size=1, max_size=6), min_size=1, max_size=12))
def test_reads_back_whatever_the_texts_hold(spark, chats):
    got = run(spark, [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)])
    for c, turns in enumerate(chats):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(text for role, text in turns if role == "assistant")
        outside = got[c]["formatted"]
        assert not any(m in outside for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_marks_that_could_not_be_read_back_are_refused():
    with pytest.raises(ValueError):
        ChatTemplate(begin="<s>")
    with pytest.raises(ValueError):
        ChatTemplate(end="<a<b>")


def test_query_has_the_added_conversation(spark):
    from cloakwork.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    row = QUERIES["op1_chat_format"](spark, folder).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert (-1, row["turns_sha256"]) in [r[:1] + r[2:3] for r in con.execute(ORACLES["op1_chat_format"]).fetchall()]
