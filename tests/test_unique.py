"""Unique values at the ends of their types."""

import pytest

from cloakwork.operators import synthesis as syn


def repaired(spark, values, kind, key=None):
    rows = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "_row long, v string").repartition(3)
    return [r["v"] for r in sorted(syn.made_unique(rows, "v", kind, key).collect(), key=lambda r: r["_row"])]


@pytest.mark.parametrize("kind, values, low, high", [
    ("int", ["2147483647", "2147483647", "5", None, "5"], -(2**31), 2**31 - 1), ("bigint", [str(2**63 - 1)] * 3 + [str(-(2**63))] * 2, -(2**63), 2**63 - 1),
    ("tinyint", ["127"] * 100 + ["-128", "-127", "3"] * 40, -128, 127), ("smallint", ["32767", "32767"], -32768, 32767),
])
def test_whole_numbers_stay_in_their_type(spark, key, kind, values, low, high):
    for k in (None, key):
        got = repaired(spark, values, kind, k)
        numbers = [int(v) for v in got if v is not None]
        assert len(set(numbers)) == len(numbers) == len([v for v in values if v is not None]) and all(low <= n <= high for n in numbers)
        first = {v: i for i, v in reversed(list(enumerate(values))) if v is not None}
        assert all(got[i] == v for v, i in first.items()) and [v is None for v in got] == [v is None for v in values]


def test_a_full_type_and_one_too_many(spark, key):
    assert sorted(map(int, repaired(spark, ["127"] * 256, "tinyint", key))) == list(range(-128, 128))
    with pytest.raises(ValueError, match="free"):
        repaired(spark, ["127"] * 257, "tinyint")


def test_days_and_decimals(spark):
    days = repaired(spark, ["9999-12-31", "9999-12-31", "0001-01-01", "0001-01-01", "9999-12-30"], "date")
    assert len(set(days)) == 5 and all(len(d) == 10 and d.count("-") == 2 for d in days) and days[0] == "9999-12-31"
    moments = repaired(spark, ["9999-12-31 10:00:00"] * 3, "timestamp")
    assert len(set(moments)) == 3 and all(m.startswith(("9999", "0001")) for m in moments)
    prices = repaired(spark, ["99.9", "99.9", "-99.9", "99.9"], "decimal(3,1)")
    assert len(set(prices)) == 4 and all(abs(float(p)) <= 99.9 and len(p.split(".")[1]) == 1 for p in prices)
    assert repaired(spark, ["5", "5", "7"], "int") == ["5", "9", "7"]  # room behind the largest: as before
