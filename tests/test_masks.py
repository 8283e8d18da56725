import re

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.keyed import MaskKey
from cloakwork.functions.masks import MASKS, Row, mask, permute_digits, shared_range
from cloakwork.operators.mapping import select_as
from helpers import on_values

SAMPLES = [
    "Jane Q Public", "jane.doe@corp.com", "+1 (415) 555-0182", "123-45-6789", "4111 1111 1111 1111", "2020-02-29", "GB82WEST12345698765432",
    "DEUTDEFF500", "021000021", "192.168.1.7", "00-1a-2b-3c-4d-5e", "{6F9619FF-8B86-D011-B42D-00C04FC964FF}", "1234.50", "AB-1234-SECRET",
    "Ünïcode Ñandú 漢字", "x", " ", "",
]
PARAMS = {"AGE": "+1y", "SECURE_LOOKUP": "a|b", "MIN_MAX": ("1", "9"), "BY_INDICATOR": ("kind", "*=TOKENIZE")}


def params(name):
    p = PARAMS.get(name)
    return p if isinstance(p, tuple) else (p, None)


@pytest.mark.parametrize(
    "fn, value, p1, p2, expected",
    [
        ("SSN", "123-45-6789", "KEEP_LAST4", "DASHED", "***-**-6789"),
        ("SSN", "123-45-6789", "REDACT", "DASHED", "***-**-****"),
        ("DATE_SHIFT", "not-a-date", "30", None, "not-a-date"),
        ("PHONE", "+1 (415) 555-0182", "KEEP_LAST4", None, "+X (XXX) XXX-0182"),
        ("PHONE", "+1 (415) 555-0182", "REDACT", None, "+* (***) ***-****"),
        ("REDACT", "AB-1234-SECRET", "#", "KEEP_LAST4", "##-####-##CRET"),
        ("REDACT", "anything", "X", "STANDARD:8", "XXXXXXXX"),
        ("BANK_ACCOUNT", "0012-3456-7890", "REDACT", None, "****-****-****"),
        ("REDACT_KEEP_LAST4", "1234567890", None, None, "******7890"),
        ("REDACT_KEEP_LAST4", "abc", None, None, "****"),
        ("AGE", "2024-01-31", "+1m", None, "2024-02-29"),
        ("AGE", "31/01/2024 10:00", "+1y -1d", None, "30/01/2025 10:00"),
        ("AGE", "2024366", "+1d", None, "2025001"),
        ("AGE", "126309", "+1d", "CYYDDD", "126310"),
        ("FIXED", "x", "gone", "UPPER", "GONE"),
        ("DIRECT_LOOKUP", " a ", "A=>1|b=>2", "CASE=UPPER;TRIM=BOTH", "1"),
        ("DIRECT_LOOKUP", "zz", "A=>1", "NOT_FOUND=REDACT", "**"),
    ],
)
def test_goldens(spark, key, fn, value, p1, p2, expected):
    assert on_values(spark, [value], lambda v: mask(fn, v, key, None, p1, p2)) == [expected]


def test_direct_lookup_without_fallback_fails(spark, key):
    with pytest.raises(Exception, match="no matching key"):
        on_values(spark, ["zz"], lambda v: mask("DIRECT_LOOKUP", v, key, p1="a=>b"))


@pytest.mark.parametrize("fn", sorted(set(MASKS) - {"MIN_MAX"}))
def test_every_function_runs_keeps_null_and_empty_and_repeats(spark, key, fn):
    p1, p2 = params(fn)
    row = Row({"kind": F.lit("k")})
    run = lambda values: on_values(spark, values, lambda v: mask(fn, v, key, None, p1, p2, row))
    first = run([*SAMPLES, None])
    assert first[-1] is None and first[SAMPLES.index("")] == ""
    assert all(x is not None for x in first[:-1])
    assert run([*reversed(SAMPLES), None])[:-1] == list(reversed(first[:-1]))


def test_same_value_same_mask_in_any_layout(spark, key):
    df = spark.range(400).select((F.col("id") % 37).cast("string").alias("v"))
    for fn in ("FORMAT_PRESERVE", "EMAIL", "SSN"):
        one = df.repartition(1).select("v", mask(fn, F.col("v"), key).alias("m")).distinct().collect()
        many = df.repartition(7).select("v", mask(fn, F.col("v"), key).alias("m")).distinct().collect()
        assert sorted(one) == sorted(many) and len(one) == 37


def test_format_is_kept(spark, key):
    values = ["Ab-12 ж漢é", "ZZZ", "0000", "naïve café"]
    out = on_values(spark, values, lambda v: mask("FORMAT_PRESERVE", v, key))
    for old, new in zip(values, out):
        assert len(old) == len(new) and old != new
        for a, b in zip(old, new):
            assert (a.isdigit(), a.isalpha(), a.isupper()) == (b.isdigit(), b.isalpha(), b.isupper())
            assert a.isalnum() or a == b


def test_valid_outputs(spark, key):
    def luhn(d):
        digits = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0

    cards = ["4111 1111 1111 1111", "378282246310005", "6011-1111-1111-1117"]
    for mode in (None, "VALID_KEEP_LAST4", "VALID_RANDOM_BIN", "FORMAT_PRESERVE"):
        for old, new in zip(cards, on_values(spark, cards, lambda v: mask("CREDIT_CARD", v, key, p1=mode))):
            digits = re.sub(r"\D", "", new)
            assert luhn(digits) and len(new) == len(old) and new != old
            if mode == "VALID_KEEP_LAST4":
                assert new[-4:] == old[-4:]
            if mode is None:
                assert digits[:6] == re.sub(r"\D", "", old)[:6]
    ssn = on_values(spark, ["900-12-3456", "666121234", "123456789"], lambda v: mask("SSN", v, key))
    assert all(re.fullmatch(r"(899|123)-(0[1-9]|[1-9]\d)-\d{4}", s) and not s.endswith("0000") for s in ssn)
    mac = on_values(spark, ["00:1A:2B:3C:4D:5E"], lambda v: mask("MAC_ADDRESS", v, key))[0]
    assert int(mac[:2], 16) & 3 == 2 and mac == mac.upper()
    bic = on_values(spark, ["DEUTDEFF500"], lambda v: mask("SWIFT_BIC", v, key))[0]
    assert re.fullmatch(r"[A-Z]{4}DE[A-Z0-9]{5}", bic)
    days = on_values(spark, ["2020-06-15"], lambda v: mask("DATE_SHIFT", v, key, p1="0:3"))
    assert days[0] in ("2020-06-16", "2020-06-17", "2020-06-18")


def test_permutation_has_no_collisions(spark, key):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    out = df.select(permute_digits(key, F.col("v"), F.lit("salt")).alias("m"))
    assert out.distinct().count() == 10_000 and out.where(F.length("m") != 4).count() == 0


def test_email_and_name_use_masked_siblings(spark, key):
    row = Row(masked={"first_name": F.lit("Ann"), "last_name": F.lit("Lee")})
    assert on_values(spark, ["x y"], lambda v: mask("FULL_NAME", v, key, p1="LAST, FIRST", row=row)) == ["Lee, Ann"]
    mail = on_values(spark, ["who@corp.com"], lambda v: mask("EMAIL", v, key, p2="PRESERVE_DOMAIN", row=row))[0]
    assert re.fullmatch(r"ann\.lee\d{1,4}@corp\.com", mail)


def test_multi_value_marks_stay(spark, key):
    out = on_values(spark, ["aýbþýcü"], lambda v: mask("TOKENIZE", v, key, multi_value=True))[0]
    assert re.sub(r"TKN_[0-9a-f]{32}", "L", out) == "LýLþýLü"


def test_split_columns_match_the_whole(spark, key):
    df = spark.createDataFrame([("123", "45", "6789", "123456789")], "a string, g string, s string, w string")
    row = Row({c: F.col(c) for c in "ags"})
    out = select_as(
        df, {**{c: mask("SSN_SPLIT", F.col(c), key, None, c, "a,g,s", row) for c in "ags"}, "w": mask("SSN", F.col("w"), key, p2="DIGITS_ONLY")}
    ).first()
    assert out["a"] + out["g"] + out["s"] == out["w"]


def test_shared_shift_range():
    assert shared_range(["30"]) is None
    assert shared_range(["30", "-5:50"]) == (-5, 30)
    with pytest.raises(ValueError):
        shared_range(["1:2", "5:9"])


def test_swift_message_keeps_structure(spark, key):
    message = "{1:F01BANKBEBBAXXX2222123456}{2:I103BANKDEFFXXXXN}{3:{108:MSG1}}{4:\r\n:20:REF9\r\n:32A:200101EUR12,50\r\n:59:/12345678\r\nJOHN DOE\r\nSTREET 1\r\n-}{5:{CHK:1}}"
    out = on_values(spark, [message, "plain text"], lambda v: mask("SWIFT_MT", v, key))
    assert out[1] == "plain text"
    shape = r"\{1:F01[A-Z]{4}BE[A-Z0-9]{2}AXXX2222123456\}\{2:I103[A-Z]{4}DE[A-Z0-9]{2}XXXXN\}\{3:\{108:MSG1\}\}\{4:\r\n:20:[A-Z]{3}\d\r\n:32A:200101EUR12,50\r\n:59:/\d{8}\r\n[A-Za-z]+ [A-Za-z]+\r\nSTREET 1\r\n-\}\{5:\{CHK:1\}\}"
    assert re.fullmatch(shape, out[0]) and "JOHN" not in out[0] and "12345678" not in out[0]


def test_secret_is_required():
    with pytest.raises(ValueError):
        MaskKey("  ")
