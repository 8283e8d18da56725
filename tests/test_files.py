"""Delimited files give back the texts that were written, whatever they hold."""

import pytest

from cloakwork.operators import loads
from cloakwork.sources import files

ODD = [None, "", " ", "\t", "\n", "\r\n", " a", "a ", "\ta", "a\n", "\r\na", "\x00a", "a\x1f", '"\n', ' "a" ', "a,b\t", "a\\", '"', '""', "\n" * 3000, "NULL"]


@pytest.mark.parametrize("sep", [",", "\t"])
def test_texts_keep_white_space_at_their_ends_and_empty_is_not_null(spark, tmp_path, sep):
    """the writer dropped white space at both ends, and empty text came back as null."""
    rows = spark.createDataFrame([(i, v, v) for i, v in enumerate(ODD)], "doc_id bigint, text string, lang string")
    loads.write_csv(rows, str(tmp_path / "rows"), sep)
    got = files.read_delimited(spark, str(tmp_path / "rows"), sep, multi_line=True)
    assert got.columns == rows.columns
    assert {int(r[0]): (r[1], r[2]) for r in got.collect()} == {i: (v, v) for i, v in enumerate(ODD)}


def test_headers_without_a_name_are_numbered(spark, tmp_path):
    (tmp_path / "rows.csv").write_text('"",b,""\n1,"",\n')
    got = files.read_delimited(spark, str(tmp_path / "rows.csv"))
    assert got.columns == ["_c0", "b", "_c2"] and [tuple(r) for r in got.collect()] == [("1", "", None)]
