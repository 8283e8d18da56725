"""Keyed one-to-one maps of numbers: a Feistel network over a square, walked until the result lies in the wanted range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.keyed import MaskKey, let, non_negative_long

ROUNDS = 6
STEPS = 64  # of a walk: one leaves the range with at most 4 / sqrt(size), and small ranges are left for fewer steps than this
WIDE = 18  # digits that the tail of a longer number holds
DIGITS = 34  # of the longest number; Spark rounds longer ones when it negates them

LIMITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def permuted(key: MaskKey, salt: str | Column, value: Column, size: Column) -> Column:
    """Image of ``value`` (0 .. size - 1) under a permutation of that range that key, salt and size choose."""
    tag = F.lit(salt) if isinstance(salt, str) else salt
    side = F.floor(F.sqrt(size.cast("double"))).cast("bigint") + 2

    def walk(a: Column) -> Column:
        def step(at: Column) -> Column:
            right = at % a
            start = F.struct(F.call_function("div", at, a).alias("l"), right.alias("r"))

            def turn(s: Column, number: Column) -> Column:
                text = F.concat_ws(":", number.cast("string"), size.cast("string"), s["r"].cast("string"))
                drawn = non_negative_long(key.digest(F.concat(tag, F.lit("|permuted")), text)) % a
                return F.struct(s["r"].alias("l"), ((s["l"] + drawn) % a).alias("r"))

            return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * a + s["r"])

        lost = F.raise_error(F.lit("a walk over a keyed permutation did not end")).cast("bigint")

        def on(begin: Column) -> Column:
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, lambda at, _: F.when(at < size, at).otherwise(step(at)))
            return F.when(begin < size, begin).otherwise(let(walked, lambda at: F.when(at.isNull() | (at < size), at).otherwise(lost)))

        return let(step(value), on)

    return let(side, walk)


def highest(kind: T.DataType) -> tuple[int, int] | None:
    """Largest magnitudes (positive, negative) of the unscaled numbers of a whole or decimal type; None for other types."""
    for whole, bits in LIMITS.items():
        if isinstance(kind, whole):
            return 2 ** (bits - 1) - 1, 2 ** (bits - 1)
    if isinstance(kind, T.DecimalType):
        return 10**kind.precision - 1, 10**kind.precision - 1
    return None


def keep_digits(key: MaskKey, salt: str, value: Column, kind: T.DataType, limit: tuple[int, int] | None = None) -> Column:
    """Another number of the same sign and number of digits, in the value's own type, one-to-one; null stays null.

    ``limit`` narrows the largest magnitudes, so that columns of different width that share a salt still join. Digits are those
    of the unscaled number: 12.50 as decimal(9,2) has four.
    """
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    most = limit or highest(kind)
    if most is None or max(most) >= 10**DIGITS:
        raise ValueError(f"no keyed permutation of {kind.simpleString()}")
    exact = "decimal(38,0)"
    if scale:  # shift the point by text: a product would round the widest decimals
        unscaled = F.regexp_replace(value.cast("string"), r"\.", "").cast(exact)
    else:
        unscaled = value.cast(exact)

    def changed(number: Column) -> Column:
        size = F.abs(number)
        digits = F.length(size.cast("string"))
        top = F.when(number < 0, F.lit(str(most[1]))).otherwise(F.lit(str(most[0]))).cast(exact)
        low = F.when(digits == 1, (number < 0).cast("int")).otherwise(F.rpad(F.lit("1"), digits, "0")).cast(exact)
        high = F.least(F.repeat(F.lit("9"), digits).cast(exact), top)
        narrow = let(
            F.struct(low.alias("low"), (high - low + 1).cast("bigint").alias("n")),
            lambda d: (permuted(key, salt, (size - d["low"]).cast("bigint"), d["n"]).cast(exact) + d["low"]).cast(exact),
        )
        if max(most) < 10**19:
            out = narrow
        else:
            out = F.when(digits <= WIDE, narrow).otherwise(_wide(key, salt, size, digits))
        return F.when(number < 0, -out).otherwise(out).cast(exact)

    new = let(unscaled, changed)
    if scale:
        text = F.lpad(F.abs(new).cast("string"), F.greatest(F.length(F.abs(new).cast("string")), F.lit(scale + 1)), "0")
        point = F.concat(F.when(new < 0, "-").otherwise(""), F.substr(text, F.lit(1), F.length(text) - scale), F.lit("."), F.right(text, F.lit(scale)))
        new = F.when(new.isNotNull(), point)
    return new.cast(kind)


def _wide(key: MaskKey, salt: str, size: Column, digits: Column) -> Column:
    """Numbers of 19 to 34 digits: head and tail change each other in turn, each step one-to-one while the other stands."""
    text = size.cast("string")
    head_digits = digits - WIDE
    low = F.rpad(F.lit("1"), head_digits, "0").cast("bigint")
    heads = low * 9

    def move(part: Column, other: Column, count: Column, name: str) -> Column:
        return permuted(key, F.concat(F.lit(f"{salt}|{name}|"), digits.cast("string"), F.lit("|"), other.cast("string")), part, count)

    all_tails = F.lit(10**WIDE).cast("bigint")
    head, tail = F.substr(text, F.lit(1), head_digits).cast("bigint") - low, F.substr(text, head_digits + 1, F.lit(WIDE)).cast("bigint")
    one = let(tail, lambda t: F.struct(move(head, t, heads, "a").alias("h"), t.alias("t")))
    two = let(one, lambda s: F.struct(s["h"].alias("h"), move(s["t"], s["h"], all_tails, "b").alias("t")))
    three = let(two, lambda s: F.struct(move(s["h"], s["t"], heads, "c").alias("h"), s["t"].alias("t")))
    return let(three, lambda s: F.concat((s["h"] + low).cast("string"), F.lpad(s["t"].cast("string"), WIDE, "0")).cast("decimal(38,0)"))
