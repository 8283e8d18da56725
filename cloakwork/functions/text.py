"""Character-level column helpers shared by the format-keeping masks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import characters, let, stream_draw

DIGIT = r"^\p{Nd}$"
ALNUM = r"^[\p{L}\p{Nd}]$"

# Runs of code points that share script and category; a letter outside ASCII moves inside its run.
SCRIPT_RUNS = [
    (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3AB), (0x3B1, 0x3C9),
    (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x5D0, 0x5EA), (0x621, 0x63A),
    (0x641, 0x64A), (0x660, 0x669), (0x6F0, 0x6F9), (0x905, 0x939), (0x966, 0x96F), (0xE01, 0xE30),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]
# Latin Extended-A alternates upper and lower case, so a letter there moves by an even step.
PAIRED_RUN = (0x100, 0x137)
RUN_TABLE = "array({})".format(
    ", ".join(
        f"named_struct('low', {low}, 'high', {high}, 'step', {step})"
        for low, high, step in [(a, b, 1) for a, b in SCRIPT_RUNS] + [(*PAIRED_RUN, 2)]
    )
)


def positions(chars: Column, pattern: str) -> Column:
    """Zero-based places of the characters that match."""
    return F.array_compact(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), i)))


def count_to(size: Column) -> Column:
    """0 .. size-1, empty when size is not positive."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def only_alnum(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[^A-Za-z0-9]", ""))


def put_back(value: Column, replacement: Column, pattern: str, tail: bool = True) -> Column:
    """Write ``replacement`` over the matching characters of ``value``, left to right; layout stays."""

    def write(new: Column) -> Column:
        def step(state: Column, char: Column) -> Column:
            used = state["used"] + 1
            written = F.struct(F.concat(state["out"], F.substr(new, used, F.lit(1))).alias("out"), used.alias("used"))
            kept = F.struct(F.concat(state["out"], char).alias("out"), state["used"].alias("used"))
            return F.when(char.rlike(pattern) & (state["used"] < F.length(new)), written).otherwise(kept)

        def finish(state: Column) -> Column:
            return F.concat(state["out"], F.substr(new, state["used"] + 1)) if tail else state["out"]

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
        return F.aggregate(characters(value), start, step, finish)

    return let(replacement, write)


def put_digits(value: Column, digits: Column) -> Column:
    """Digits back into the original layout; all-digit values skip the walk."""
    return F.when(value.rlike("^[0-9]*$"), digits).otherwise(put_back(value, digits, DIGIT))


def put_alnum(value: Column, text: Column) -> Column:
    """Letters and digits back into the layout, lower case where the source letter was lower case."""

    def fit(filled: Column) -> Column:
        return F.array_join(
            F.zip_with(
                characters(value),
                characters(filled),
                lambda old, new: F.when(old.rlike(r"^\p{Ll}$"), F.lower(new)).otherwise(new),
            ),
            "",
        )

    return F.when(value.rlike("^[0-9A-Z]*$"), text).otherwise(let(put_back(value, text, ALNUM, tail=False), fit))


def keep_ends(value: Column, mask: str, first: int, last: int, pattern: str = r"[\p{L}\p{Nd}]") -> Column:
    """Replace matching characters by ``mask`` except the first and last few of them."""
    if first == 0 and last == 0:
        return F.regexp_replace(value, pattern, F.lit(re.sub(r"([\\$])", r"\\\1", mask)))
    total = F.length(value) - F.length(F.regexp_replace(value, pattern, ""))

    def step(state: Column, char: Column) -> Column:
        hit = char.rlike(pattern)
        seen = state["seen"] + 1
        hidden = hit & (seen > first) & (seen <= total - last)
        return F.struct(
            F.concat(state["out"], F.when(hidden, F.lit(mask)).otherwise(char)).alias("out"),
            F.when(hit, seen).otherwise(state["seen"]).alias("seen"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))
    return F.aggregate(characters(value), start, step, lambda state: state["out"])


def code_point(number: Column) -> Column:
    """Character for a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")


def moved_letter(char: Column, draw: Callable[[Column | int], Column]) -> Column:
    """Another character of the same kind: digit, case and script stay. ``draw(n)`` gives 0..n-1."""

    def kept_kind(code: Column) -> Column:
        def turned(base: int, size: int) -> Column:
            return F.char(base + (code - base + 1 + draw(size - 1)) % size)

        def in_run(run: Column) -> Column:
            low, step = run["low"], run["step"]
            places = (run["high"] - low + 1) / step
            moved = low + (code - low + step * (1 + draw((places - 1).cast("bigint")))) % (run["high"] - low + 1)
            fallback = (
                F.when(char.rlike(r"^\p{Lu}$"), F.lit("X"))
                .when(char.rlike(r"^\p{L}$"), F.lit("x"))
                .when(char.rlike(r"^\p{Nd}$"), F.lit("0"))
                .otherwise(char)
            )
            return F.when(run.isNull(), fallback).otherwise(code_point(moved.cast("bigint")))

        own = F.get(F.filter(F.expr(RUN_TABLE), lambda r: (code >= r["low"]) & (code <= r["high"])), F.lit(0))
        return (
            F.when(code.between(97, 122), turned(97, 26)).when(code.between(65, 90), turned(65, 26))
            .when(code.between(48, 57), turned(48, 10)).when(code < 128, char).otherwise(let(own, in_run))
        )

    return let(F.ascii(char), kept_kind)


def shuffle_letters(value: Column, stream: Column, keep_digits: Column | int = 0) -> Column:
    """Every digit and letter becomes another of its kind; the first ``keep_digits`` digits stay."""

    def walk(keys: Column) -> Column:
        def at_place(c: Column, i: Column) -> Column:
            return moved_letter(c, lambda bound: stream_draw(F.get(keys, i), F.lit(0), bound))

        if isinstance(keep_digits, int) and keep_digits == 0:
            return F.array_join(F.transform(characters(value), at_place), "")

        def with_kept(chars: Column) -> Column:
            return let(
                F.slice(positions(chars, DIGIT), F.lit(1), keep_digits),
                lambda kept: F.array_join(
                    F.transform(
                        chars, lambda c, i: F.when(F.array_contains(kept, i), c).otherwise(at_place(c, i))
                    ),
                    "",
                ),
            )

        return let(characters(value), with_kept)

    # cut into draws once: a look into the whole stream at each place would cost the square of a long text
    return let(F.regexp_extract_all(stream, F.lit(".{4}"), F.lit(0)), walk)


def random_digits(stream: Column, count: Column) -> Column:
    return F.array_join(
        F.transform(count_to(count), lambda i: stream_draw(stream, i, 10).cast("string")), ""
    )


def replace_matches(value: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Rewrite each match of a (non-empty) pattern, keep everything between matches."""
    gaps = F.split(value, pattern, -1)
    found = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(gaps, found, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")


def proper_case(value: Column) -> Column:
    """Capital after a space, hyphen, apostrophe or comma; the rest lower case."""

    def step(state: Column, char: Column) -> Column:
        previous = F.substring(state, -1, 1)
        start = (state == "") | previous.isin(" ", "-", "'", ",")
        return F.concat(state, F.when(start, F.upper(char)).otherwise(char))

    return F.aggregate(characters(F.lower(value)), F.lit(""), step)


def in_case(value: Column, mode: str | None) -> Column:
    kind = (mode or "").strip().upper().replace("-", "_").replace(" ", "_")
    if kind in ("LOWER", "LOWERCASE"):
        return F.lower(value)
    if kind in ("UPPER", "UPPERCASE"):
        return F.upper(value)
    if kind in ("PROPER", "TITLE", "TITLE_CASE"):
        return proper_case(value)
    return value


CASE_MODES = {
    "LOWER", "LOWERCASE", "UPPER", "UPPERCASE", "PROPER", "TITLE", "TITLE_CASE", "AS_IS", "PRESERVE", "ORIGINAL",
}


def case_of(*params: str | None) -> str | None:
    """First parameter that names a case mode."""
    for p in params:
        if p and p.strip().upper().replace("-", "_").replace(" ", "_") in CASE_MODES:
            return p
    return None


def like_source_case(source: Column, new: Column) -> Column:
    """Carry upper, lower or proper case of a segment over to its replacement."""
    letters = source.rlike(r"\p{L}")
    same_upper = (source == F.upper(source)) & (source != F.lower(source))
    same_lower = (source == F.lower(source)) & (source != F.upper(source))
    proper = source.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    title = F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substr(new, F.lit(2))))
    return (
        F.when(~letters, new)
        .when(same_upper, F.upper(new))
        .when(same_lower, F.lower(new))
        .when(proper, title)
        .otherwise(new)
    )
