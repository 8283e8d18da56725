"""What must not grow faster than a table: tasks hold a bounded number of rows, long texts are hashed once, draws stand once."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cloakwork import session
from cloakwork.functions import generators as gen
from cloakwork.functions.generators import Source, Spec
from cloakwork.functions.keyed import LONG_VALUE
from cloakwork.functions.masks import AREA_CODES
from cloakwork.plans import load_queries
from helpers import on_values


def hmac_hex(salt, value):
    return hmac.new(b"test-secret", f"{salt}\x1f{value}".encode(), hashlib.sha256).hexdigest()


def test_a_phone_comes_back_with_an_extension_when_all_are_used(spark, key):
    """the row after the last reserved number must not repeat the first one."""
    last = AREA_CODES * 100
    rows = spark.createDataFrame([(1,), (last,), (last + 1,), (2 * last + 1,)], "row bigint")
    made = rows.select(gen.generate(Spec("PHONE_US"), Source(key, "p.phone"), F.col("row")).alias("v"), "row").orderBy("row").collect()
    first, end, again, third = (r["v"] for r in made)
    assert again == f"{first} x1" and third == f"{first} x2" and " x" not in first + end


def test_long_values_are_hashed_once_in_a_stream(spark, key):
    """each block hashed the whole text before, the square of its length in all."""
    short, long = "a" * LONG_VALUE, "b" * (LONG_VALUE + 1)
    got = on_values(spark, [short, long], lambda v: key.stream("s", v, F.lit(32)))
    stands = hmac_hex("s#long", long)
    assert got == [hmac_hex("s#0", short) + hmac_hex("s#1", short), hmac_hex("s#0", stands) + hmac_hex("s#1", stands)]


def test_a_number_computes_its_digest_once(spark, key):
    """F8, F9, F10, F13: two places of the digest were two digests wherever Spark does not generate code."""
    assert str(key.number("s", F.col("v"))).lower().count("sha2") == 2


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    """a table of any size was dealt to as many tasks as there are cores, or not at all."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.spread(spark.range(0, 500, 1, 1)).rdd.getNumPartitions() == 50
    assert session.spread(spark.range(0, 5, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name, tasks", [("mask_phone_split_columns", 15), ("text_mask_json_by_path", 150)])
def test_costly_queries_are_dealt_by_rows(spark, monkeypatch, name, tasks):
    """one task masked the whole table."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert load_queries()[0][name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks


def plan_of(df, capsys):
    df.explain(True)
    return capsys.readouterr().out


@pytest.mark.parametrize(
    "name, tasks",
    [("generate_unique_cards", 150), ("policy_numbers_keep_type_and_digits", 150), ("check_format_contracts", 15), ("check_masked_values_are_not_real", 15)],
)
def test_costly_aggregates_are_dealt_by_rows(spark, monkeypatch, capsys, name, tasks):
    """F5, F7, F8, F12: the tasks that mask or hold distinct cards follow the rows."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    plan = plan_of(load_queries()[0][name](spark, "/root/testdata/sf0.001"), capsys)
    dealt = f"{tasks}), REPARTITION_BY_NUM"
    assert dealt in plan
    if name == "generate_unique_cards":
        assert "card#" in next(line for line in plan.splitlines() if dealt in line and "hashpartitioning" in line)
