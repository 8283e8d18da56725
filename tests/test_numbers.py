"""Numbers masked one-to-one inside their own type."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.numbers import highest, keep_digits, permuted
from cloakwork.operators.discovery import sensitivity
from cloakwork.operators.policy import Policy, Rule, apply_policy, key_limits, mask_tables
from cloakwork.operators.subset import Edge


@pytest.mark.parametrize("size", [1, 2, 3, 9, 10, 90, 225, 226, 900])
def test_a_permutation_of_every_small_range(spark, key, size):
    rows = spark.range(size).select("id", permuted(key, "s", F.col("id"), F.lit(size).cast("bigint")).alias("m")).collect()
    assert sorted(r["m"] for r in rows) == list(range(size))


@pytest.mark.parametrize("kind, values", [
    ("tinyint", list(range(-128, 128))), ("smallint", [*range(9990, 10010), *range(32700, 32768), -32768, -32767, 0]),
    ("int", [2147483647, 2147483646, -2147483648, 1000000000, 3953, 0, None]), ("bigint", [2**63 - 1, -(2**63), 10**18, 10**17, 5]),
    ("decimal(9,2)", [Decimal("12.50"), Decimal("-0.05"), Decimal("9999999.99"), Decimal("0.00"), None]),
    ("decimal(34,4)", [Decimal("1234567890123456789012.3456"), Decimal("-" + "9" * 30 + ".9999"), Decimal("1000000000000000.0000")]),
])
def test_same_sign_and_digits_and_one_to_one(spark, key, kind, values):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    got = frame.select("v", keep_digits(key, "s", F.col("v"), frame.schema["v"].dataType).alias("m")).collect()
    pairs = {(r["v"], r["m"]) for r in got if r["v"] is not None}
    assert len({m for _, m in pairs}) == len(pairs) and all(r["m"] is None for r in got if r["v"] is None)
    for v, m in pairs:
        digits = [len(str(x).lstrip("-").replace(".", "").lstrip("0")) for x in (v, m)]
        assert "," in kind and v == 0 or digits[0] == digits[1] or abs(v) < 10, (v, m)
        assert (m >= 0 or v < 0) and isinstance(m, type(v))
    again = frame.select(keep_digits(key, "s", F.col("v"), frame.schema["v"].dataType).alias("m")).collect()
    assert [r["m"] for r in again] == [r["m"] for r in got]


def test_policies_on_numbers_never_leave_the_type(spark, key):
    draw = random.Random(3)
    keys = sorted({draw.randrange(10**9, 2**31) for _ in range(400)})
    a = spark.createDataFrame([(k,) for k in keys], "id int")
    b = spark.createDataFrame([(k, k % 30000) for k in keys[::3]], "ref bigint, small smallint")
    rules = [Rule("a", "id", "FORMAT_PRESERVE"), Rule("b", "ref", "FORMAT_PRESERVE"), Rule("b", "small", "CHARACTER_MAP")]
    edges = [Edge("b", "ref", "a", "id")]
    assert key_limits(edges, {"a": a, "b": b})[("b", "ref")] == highest(T.IntegerType())
    out = mask_tables({"a": a, "b": b}, Policy(key, rules), edges)
    assert out["a"].distinct().count() == len(keys) and out["a"].schema == a.schema and out["b"].schema == b.schema
    assert out["b"].join(out["a"], F.col("ref") == F.col("id")).count() == len(keys[::3])
    lone = apply_policy(spark.createDataFrame([(3953033707 % 2**31, "x")], "n int, t string"), "c", Policy(key, [Rule("c", "n", "FORMAT_PRESERVE")]))
    assert lone.first()["n"] is not None
    text = spark.createDataFrame([("7",)], "ref string")
    assert key_limits([Edge("b", "ref", "a", "id")], {"a": a, "b": text})[("a", "id")] is None
    with pytest.raises(ValueError):
        keep_digits(key, "s", F.col("x"), T.DecimalType(38, 0))


def test_names_of_identifiers_and_people():
    assert sensitivity("CARD_CUSTOMER_ID", True) == ("TECHNICAL_IDENTIFIER", "SEQUENCE")
    assert sensitivity("ACCOUNT_OWNER_KEY") == ("TECHNICAL_IDENTIFIER", "PADDED_SEQUENCE")
    assert sensitivity("CUSTOMER_TAX_ID") == ("PII_TAX_ID", "ALPHANUMERIC") and sensitivity("tin") == ("PII_TAX_ID", "ALPHANUMERIC")
    assert sensitivity("ssn") == ("PII_TAX_ID", "SSN") and sensitivity("account_status") is None
    assert sensitivity("female_first_name") == ("PII_NAME", "FEMALE_FIRST_NAME") and sensitivity("father_name") == ("PII_NAME", "MALE_FIRST_NAME")
    assert sensitivity("credit_score")[0] == "BANKING_CONTROL" and sensitivity("CARD_NUMBER") == ("PCI_CARD", "CREDIT_CARD_VISA")
    assert sensitivity("transaction_memo") == ("TRANSACTION_DESCRIPTOR", "LOREM_SENTENCE") and sensitivity("notes") is None
