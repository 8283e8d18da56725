"""Keyed, deterministic values: HMAC-SHA256 as a column expression, picks and draws from it.

Everything here is a plain Catalyst expression. The two key pads are literals made once on the driver, so a
digest costs two ``sha2`` calls per value and needs no UDF, no shared table and no shuffle: equal values get
equal results in every table, task and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = b"\x1f"
LONG_VALUE = 1024  # characters of a value that is hashed whole in every block of a stream


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (also inside lambdas).

    The fold over no elements only carries the value to its end. An item of a transformed array would do the same, but
    Spark asks such an array for its type at each row, which walks the whole expression below ``body``.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def normalise(value: Column) -> Column:
    return F.lower(F.trim(value))


def characters(value: Column) -> Column:
    """Array of code points (a plain split would cut surrogate pairs)."""
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def hex_number(text: Column) -> Column:
    """Number in a hex string of up to eight digits."""
    return F.conv(text, 16, 10).cast("bigint")


def non_negative_long(digest: Column) -> Column:
    """First eight bytes of a digest with the top bit cleared; the digest stands once, so it is computed once."""
    signed = F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")
    return signed.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint"))


class Draws:
    """Up to eight independent 32-bit draws taken from one digest."""

    def __init__(self, digest: Column):
        self.digest = digest

    def raw(self, index: int) -> Column:
        if not 0 <= index < 8:
            raise ValueError("a digest holds eight draws")
        return hex_number(F.substring(self.digest, 8 * index + 1, 8))

    def wide(self, index: int) -> Column:
        """63-bit draw; draws 2k and 2k + 1 share their bits with wide draw 2k."""
        if not 0 <= index < 8:
            raise ValueError("a digest holds eight draws")
        return non_negative_long(F.substring(self.digest, 16 * (index // 2) + 1, 16))

    def below(self, index: int, bound: int) -> Column:
        """Draw below a bound; bounds that 32 bits cannot fill evenly take a wide draw."""
        draw = self.raw(index) if bound <= 1 << 31 else self.wide(index)
        return draw % F.lit(bound).cast("bigint")

    def fine_unit(self, index: int) -> Column:
        """Double in [0, 1) with 53 random bits."""
        return F.shiftright(self.wide(index), 10).cast("double") / F.lit(9007199254740992.0)

    def digits(self, index: int, width: int) -> Column:
        """``width`` (at most nine) decimal digits."""
        return F.lpad(self.below(index, 10**width).cast("string"), width, "0")

    def unit(self, index: int) -> Column:
        """Double in [0, 1)."""
        return self.raw(index).cast("double") / F.lit(4294967296.0)

    def choice(self, index: int, options: Sequence[str]) -> Column:
        return at(options, self.below(index, len(options)))


def at(options: Sequence[str], position: Column) -> Column:
    """Entry of a short literal list at a zero-based position."""
    return F.element_at(literal_list(tuple(options)), (position + 1).cast("int"))


def literal_list(options: Sequence[str]) -> Column:
    quoted = ", ".join("'" + o.replace("\\", "\\\\").replace("'", "\\'") + "'" for o in options)
    return F.expr(f"array({quoted})")


class MaskKey:
    """Secret plus optional job seed. Equal key, salt and value give an equal result everywhere."""

    def __init__(self, secret: str, seed: str | None = None):
        if not secret or not secret.strip():
            raise ValueError("masking secret required")
        self.base = secret
        if seed is not None and seed.strip():
            secret = f"{secret}::seed::{seed.strip()}"
        self.secret = secret
        raw = secret.encode("utf-8")
        if len(raw) > 64:
            raw = hashlib.sha256(raw).digest()
        raw = raw.ljust(64, b"\0")
        self.inner = bytes(b ^ 0x36 for b in raw)
        self.outer = bytes(b ^ 0x5C for b in raw)

    def with_seed(self, seed: str | None) -> "MaskKey":
        return MaskKey(self.secret, seed) if seed and seed.strip() else self

    def digest(self, salt: str | Column, value: Column) -> Column:
        """HMAC-SHA256(secret, salt, 0x1f, value) as 64 hex digits."""
        if isinstance(salt, str):
            head = [F.lit(bytearray(self.inner + salt.encode("utf-8") + SEPARATOR))]
        else:
            head = [F.lit(bytearray(self.inner)), salt.cast("binary"), F.lit(bytearray(SEPARATOR))]
        inner = F.sha2(F.concat(*head, value.cast("string").cast("binary")), 256)
        return F.sha2(F.concat(F.lit(bytearray(self.outer)), F.unhex(inner)), 256)

    def number(self, salt: str | Column, value: Column) -> Column:
        """Non-negative 63-bit number."""
        return non_negative_long(self.digest(salt, value))

    def index(self, salt: str | Column, value: Column, size: int) -> Column:
        """Zero-based position in a list of ``size`` entries."""
        if size <= 0:
            raise ValueError("empty list")
        return self.number(salt, value) % F.lit(size).cast("bigint")

    def pick(self, salt: str | Column, value: Column, options: Sequence[str]) -> Column:
        return at(options, self.index(salt, value, len(options)))

    def draws(self, salt: str | Column, value: Column, block: int = 0) -> Draws:
        """Draw i of a value = 32-bit slice i of the digest over ``salt#block``."""
        tagged = f"{salt}#{block}" if isinstance(salt, str) else F.concat(salt, F.lit(f"#{block}"))
        return Draws(self.digest(tagged, value))

    def stream(self, salt: str | Column, value: Column, length: Column) -> Column:
        """Hex text with four digits per position: draw i of a long value is ``stream[4i:4i+4]``.

        Blocks are digests over the value; a value beyond ``LONG_VALUE`` stands in its blocks by its own digest, because
        hashing all of it once per block would cost the square of its length.
        """
        prefix = F.lit(salt) if isinstance(salt, str) else salt
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((length - 1) / 16), F.lit(0)).cast("int"))
        text = value.cast("string")
        short = F.when(F.length(text) > LONG_VALUE, self.digest(F.concat(prefix, F.lit("#long")), text)).otherwise(text)
        return let(
            F.struct(prefix.alias("salt"), short.alias("value")),
            lambda d: F.array_join(
                F.transform(blocks, lambda b: self.digest(F.concat(d["salt"], F.lit("#"), b.cast("string")), d["value"])), ""
            ),
        )


def stream_draw(stream: Column, position: Column, bound: Column | int) -> Column:
    """Draw at a zero-based position of a stream, below ``bound``."""
    size = F.lit(bound).cast("bigint") if isinstance(bound, int) else bound
    return hex_number(F.substring(stream, (position * 4 + 1).cast("int"), F.lit(4))) % size


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Mod-10 sum from the right; ``doubled_first`` is true for a body without its check digit."""
    offset = 1 if doubled_first else 0

    def term(char: Column, place: Column) -> Column:
        digit = F.ascii(char) - 48
        twice = digit * 2
        return F.when(
            (place + offset) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)
        ).otherwise(digit)

    terms = F.transform(characters(F.reverse(digits)), term)
    return F.aggregate(terms, F.lit(0), lambda total, x: total + x)


def luhn_valid(digits: Column) -> Column:
    """Twelve or more digits with a correct check digit."""
    shaped = digits.rlike("^[0-9]{12,}$")
    return F.coalesce(F.when(shaped, luhn_sum(digits, False) % 10 == 0).otherwise(F.lit(False)), F.lit(False))


def luhn_digit(body: Column) -> Column:
    """Check digit that completes ``body``."""
    return ((F.lit(10) - luhn_sum(body, True) % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    """Remainder of an ISO 7064 string: letters count as two digits (A = 10)."""

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(characters(F.upper(text)), F.lit(0), step)


def iban_valid(value: Column, countries: Sequence[str] | None = None) -> Column:
    compact = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    shaped = compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$")
    if countries is not None:
        shaped = shaped & F.substring(compact, 1, 2).isin(*countries)
    turned = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    return F.coalesce(F.when(shaped, mod97(turned) == 1).otherwise(F.lit(False)), F.lit(False))


def weighted_digit_sum(digits: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, weight in enumerate(weights):
        total = total + (F.ascii(F.substring(digits, i + 1, 1)) - 48) * weight
    return total
