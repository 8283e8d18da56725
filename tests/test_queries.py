"""Registered queries beside their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from cloakwork.plans import load_queries
from verify import TABLES, fingerprint

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_queries()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    frame = QUERIES[name](spark, FOLDER)
    got = fingerprint(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert got[0] > 0
        return
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = fingerprint(columns, cursor.fetchall())
    assert sorted(frame.columns) == sorted(columns)
    assert got[:2] == want[:2], (sorted(set(got[2]) - set(want[2]))[:3], sorted(set(want[2]) - set(got[2]))[:3])
