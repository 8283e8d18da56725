import hashlib
import hmac

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.functions.keyed import MaskKey, iban_valid, luhn_digit, luhn_valid, mod97
from helpers import on_values


def expected(secret, salt, value):
    return hmac.new(secret.encode(), salt.encode() + b"\x1f" + value.encode(), hashlib.sha256).hexdigest()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=40).filter(lambda s: "\x00" not in s and s.isprintable()), min_size=1, max_size=20))
def test_digest_is_hmac(spark, values):
    for secret in ("short", "x" * 200):
        assert on_values(spark, values, lambda v: MaskKey(secret).digest("salt", v)) == [expected(secret, "salt", v) for v in values]


def test_number_and_pick_follow_the_digest(spark, key):
    values = [f"v{i}" for i in range(200)]
    numbers = on_values(spark, values, lambda v: key.number("s", v))
    assert numbers == [int(expected("test-secret", "s", v)[:16], 16) & (2**63 - 1) for v in values]
    picks = on_values(spark, values, lambda v: key.pick("s", v, ["a", "it's", "c\\d"]))
    assert picks == [["a", "it's", "c\\d"][n % 3] for n in numbers]


def test_salt_column_equals_salt_text(spark, key):
    values = ["a", "b"]
    assert on_values(spark, values, lambda v: key.digest(F.lit("s"), v)) == on_values(spark, values, lambda v: key.digest("s", v))


def test_seed_changes_everything_and_blank_seed_nothing(spark, key):
    base = on_values(spark, ["a"], lambda v: key.digest("s", v))
    assert on_values(spark, ["a"], lambda v: key.with_seed(" ").digest("s", v)) == base
    assert on_values(spark, ["a"], lambda v: key.with_seed("2").digest("s", v)) != base


def test_luhn(spark):
    cards = ["4111111111111111", "4111111111111112", "378282246310005", "123", None, "abc"]
    assert on_values(spark, cards, luhn_valid) == [True, False, True, False, False, False]
    bodies = [c[:-1] for c in ("4111111111111111", "378282246310005", "6011111111111117")]
    assert on_values(spark, bodies, luhn_digit) == ["1", "5", "7"]


def test_mod97_and_iban(spark):
    texts = ["123456", "GB82WEST12345698765432"]
    number = int("".join(str(ord(c) - 55) if c.isalpha() else c for c in texts[1]))
    assert on_values(spark, texts, mod97) == [123456 % 97, number % 97]
    ibans = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "DE89370400440532013000", "", None]
    assert on_values(spark, ibans, iban_valid) == [True, False, True, False, False]
