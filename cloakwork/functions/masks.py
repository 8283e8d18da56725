"""Masking functions: column in, column out, all as Catalyst expressions.

Every function takes ``(key, value, salt, p1, p2, row)``. ``value`` is a string column (or a lambda variable, so a
mask also works on array elements), ``salt`` names the logical attribute, ``row`` gives sibling columns. Input
that does not have the expected shape gets the format-keeping mask instead of passing through.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions import wordlists as words
from cloakwork.functions.keyed import (
    Draws, MaskKey, at, characters, let, luhn_digit, luhn_sum, luhn_valid, mod97, normalise, stream_draw, weighted_digit_sum,
)
from cloakwork.functions.text import (
    case_of, count_to, in_case, keep_ends, like_source_case, only_alnum, only_digits, put_alnum, put_digits,
    random_digits, replace_matches, shuffle_letters,
)

Salt = str | Column


@dataclass
class Row:
    """What a mask may see of its row: original columns and already masked siblings, by lower-case name."""

    columns: Mapping[str, Column] = field(default_factory=dict)
    masked: Mapping[str, Column] = field(default_factory=dict)
    shared_shift: Column | None = None
    index: Column | None = None
    shaped: bool = False  # the value is known to have the function's shape, so no other form is planned

    def original(self, name: str) -> Column:
        found = self.columns.get(name.strip().lower())
        return found.cast("string") if found is not None else F.lit(None).cast("string")


# Salts that keep one attribute masked the same way in every table.
SALTS = {
    "FIRST_NAME": "name.first", "LAST_NAME": "name.last", "FULL_NAME": "name.full", "EMAIL": "email",
    "SSN": "ssn", "CREDIT_CARD": "ccn", "PHONE": "phone", "CITY_STATE_ZIP": "geo", "ADDRESS_STREET": "addr",
    "ADDRESS_US": "addr.us", "COMPANY": "company", "DOB_AGE_BAND": "dob", "BANK_ACCOUNT": "bank.account",
    "IBAN": "iban", "SWIFT_BIC": "swift.bic", "ABA_ROUTING": "routing.aba", "NATIONAL_ID": "national.id",
    "IP_ADDRESS": "network.ip", "MAC_ADDRESS": "network.mac", "DIRECT_LOOKUP": "lookup.direct",
    "HASH_LOOKUP": "lookup.hash",
}
# Evaluation order of a policy (names first, composed values last).
PRIORITY = {"FIRST_NAME": 0, "LAST_NAME": 0, "FULL_NAME": 2, "EMAIL": 2, "SCRIPT": 2}


def tag(salt: Salt, suffix: str) -> Salt:
    """Salt with a suffix, for text and column salts alike."""
    return salt + suffix if isinstance(salt, str) else F.concat(salt, F.lit(suffix))


def mode_of(text: str | None, default: str) -> str:
    return text.strip().upper() if text and text.strip() else default


# ---------------------------------------------------------------- shape-keeping base

def keep_format(key: MaskKey, value: Column, salt: Salt, keep_digits: Column | int = 0) -> Column:
    stream = key.stream(tag(salt, "|fpe"), value, F.length(value))
    return shuffle_letters(value, stream, keep_digits)


def character_map(key: MaskKey, value: Column, salt: Salt, spec: str | None = None) -> Column:
    """Whole-value character mapping; ``FIRST:n`` / ``LAST:n`` keep the ends."""
    masked = keep_format(key, value, tag(salt, "|character-map"))
    kept = {}
    for side in ("FIRST", "LAST"):
        found = re.search(rf"(?:^|[,;])\s*{side}\s*[:=]\s*(\d+)", spec or "", re.I)
        kept[side] = int(found.group(1)) if found else 0
    first, last = kept["FIRST"], kept["LAST"]
    if not first and not last:
        return masked
    size = F.length(value)
    start = F.least(F.lit(first), size)
    end = F.greatest(size - last, start)
    return F.concat(
        F.substr(value, F.lit(1), start),
        F.substr(masked, start + 1, end - start),
        F.substr(value, end + 1, size - end),
    )


def or_else(shape: Column, masked: Column, other: Callable[[], Column], row: Row | None) -> Column:
    """Mask of a value with the expected shape, the other form for the rest."""
    if row is not None and row.shaped:
        return masked
    return F.when(shape, masked).otherwise(other())


# ---------------------------------------------------------------- names and e-mail

def first_pick(key: MaskKey, salt: Salt, value: Column) -> Column:
    return words.first_name(key.index(tag(salt, "|first_names.txt"), normalise(value), words.FIRST_SIZE))


def last_pick(key: MaskKey, salt: Salt, value: Column) -> Column:
    return words.last_name(key.index(tag(salt, "|last_names.txt"), normalise(value), words.LAST_SIZE))


def first_name(key, value, salt, p1=None, p2=None, row=None):
    return in_case(first_pick(key, salt, value), case_of(p2, p1))


def last_name(key, value, salt, p1=None, p2=None, row=None):
    return in_case(last_pick(key, salt, value), case_of(p2, p1))


def company(key, value, salt, p1=None, p2=None, row=None):
    return in_case(key.pick(tag(salt, "|companies.txt"), normalise(value), words.COMPANIES), case_of(p2, p1))


def full_name(key, value, salt, p1=None, p2=None, row=None):
    """First, middle and last token masked with the name salts, or composed from masked siblings."""
    tokens = F.split(F.trim(value), r"\s+")
    head, tail = F.element_at(tokens, 1), F.element_at(tokens, -1)
    middle_raw = F.when(F.size(tokens) > 2, F.array_join(F.slice(tokens, F.lit(2), F.size(tokens) - 2), " "))
    masked = row.masked if row else {}
    if "first_name" in masked and "last_name" in masked:
        first = F.coalesce(masked["first_name"], first_pick(key, "name.first", head))
        last = F.coalesce(masked["last_name"], last_pick(key, "name.last", tail))
    else:
        first, last = first_pick(key, "name.first", head), last_pick(key, "name.last", tail)
    pattern = p1.strip() if p1 and p1.strip() else "FIRST LAST"
    parts: list[Column] = []
    for piece in re.split(r"(\bMIDDLE\b|\bMID\b|\bFIRST\b|\bLAST\b)", pattern, flags=re.I):
        word = piece.upper()
        if word == "FIRST":
            parts.append(first)
        elif word == "LAST":
            parts.append(last)
        elif word in ("MID", "MIDDLE"):
            parts.append(
                F.when(middle_raw.isNull(), F.lit("")).otherwise(first_pick(key, "name.middle", middle_raw))
            )
        elif piece:
            parts.append(F.lit(piece))
    out = F.concat(*parts)
    if len(parts) > 3 or "," in pattern:
        out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\s+,", ",")
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r",\s*", ", "), r"(,\s*)+$", ""))
    return in_case(out, case_of(p2))


EMAIL_MODES = {"NAME_SAFE", "USER_SAFE", "HASH_LOCAL", "REDACT_LOCAL", "PRESERVE_DOMAIN"}


def email(key, value, salt, p1=None, p2=None, row=None):
    mode = mode_of(p1, "NAME_SAFE")
    keep_domain = mode == "PRESERVE_DOMAIN" or mode_of(p2, "") == "PRESERVE_DOMAIN"
    if mode not in EMAIL_MODES or mode == "PRESERVE_DOMAIN":
        mode = "NAME_SAFE"
    clean = normalise(value)
    domain = key.pick(tag(salt, "|email.dom"), clean, words.SAFE_DOMAINS)
    if keep_domain:
        own = F.when(value.contains("@"), F.substr(value, F.locate("@", value) + 1))
        domain = F.when(F.trim(own) != "", own).otherwise(domain)
    if mode == "REDACT_LOCAL":
        return F.concat(F.lit("masked@"), domain)
    if mode == "HASH_LOCAL":
        number = key.index(tag(salt, "|email.hash"), clean, 1_000_000)
        return F.concat(F.lit("user"), F.lpad(number.cast("string"), 6, "0"), F.lit("@"), domain)
    local_part = F.substring_index(value, "@", 1)
    suffix = key.index(tag(salt, "|email.sfx"), clean, 10_000).cast("string")
    masked = row.masked if row else {}
    if mode == "USER_SAFE":
        local = F.lower(first_pick(key, "email.user", local_part))
    else:
        local = F.lower(
            F.concat(first_pick(key, "name.first", local_part), F.lit("."), last_pick(key, "name.last", local_part))
        )
        if "first_name" in masked and "last_name" in masked:
            both = F.lower(F.concat(masked["first_name"], F.lit("."), masked["last_name"]))
            local = F.coalesce(both, local)
    return F.concat(local, suffix, F.lit("@"), domain)


# ---------------------------------------------------------------- phone, SSN, cards

# International calling codes by length (all others have three digits).
ONE_DIGIT_CODES = ["1", "7"]
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 "
    "86 90 91 92 93 94 95 98"
).split()
AREA_CODES = 8 * 99 - 1  # 200..999 without N11 and 555


def area_code(position: Column) -> Column:
    """Assignable area code at a position below AREA_CODES."""
    slot = F.when(position < 351, position).otherwise(position + 1)
    low = slot % 99
    return (200 + F.floor(slot / 99) * 100 + F.when(low < 11, low).otherwise(low + 1)).cast("int")


def calling_code_length(value: Column) -> Column:
    digits = only_digits(value)
    return (
        F.when(~value.rlike(r"^\s*\+") | (digits == ""), F.lit(0))
        .when(F.substring(digits, 1, 1).isin(*ONE_DIGIT_CODES), F.lit(1))
        .when(F.substring(digits, 1, 2).isin(*TWO_DIGIT_CODES), F.lit(2))
        .otherwise(F.least(F.lit(3), F.length(digits)))
    )


def fictional_digits(key: MaskKey, digits: Column, salt: Salt, keep_area: bool) -> Column:
    """NANP digits moved into 555-0100..0199; null for other lengths."""
    country = (F.length(digits) == 11) & digits.startswith("1")
    body = F.when(country, F.substring(digits, 2, 10)).when(F.length(digits) == 10, digits)

    def build(original: Column) -> Column:
        area = area_code(key.index(tag(salt, "|phone.nanp.area"), original, AREA_CODES)).cast("string")
        if keep_area:
            own = F.substring(original, 1, 3)
            good = own.rlike("^[2-9]") & ~own.rlike("^.11$") & (own != "555")
            area = F.when(good, own).otherwise(area)
        line = key.index(tag(salt, "|phone.nanp.line"), original, 100)
        number = F.concat(area, F.lit("555"), F.lpad((100 + line).cast("string"), 4, "0"))
        other = F.concat(area, F.lit("555"), F.lpad((100 + (line + 1) % 100).cast("string"), 4, "0"))
        new = F.when(number == original, other).otherwise(number)
        return F.when(original.isNotNull(), F.when(country, F.concat(F.lit("1"), new)).otherwise(new))

    return let(body, build)


def fictional_phone(key: MaskKey, value: Column, salt: Salt, keep_area: bool) -> Column:
    new = fictional_digits(key, only_digits(value), salt, keep_area)
    return let(new, lambda digits: F.when(digits.isNotNull(), put_digits(value, digits)))


def phone(key, value, salt, p1=None, p2=None, row=None):
    mode = mode_of(p1, "FORMAT_PRESERVE")
    if mode == "REDACT":
        return F.regexp_replace(value, r"\d", "*")
    if mode == "KEEP_LAST4":
        return keep_ends(value, "X", 0, 4, r"\p{Nd}")
    if mode == "DIGITS_ONLY":
        digits = only_digits(value)
        return F.coalesce(fictional_digits(key, digits, salt, False), keep_format(key, digits, salt))
    if mode == "PRESERVE_AREA":
        digits = only_digits(value)
        kept = F.least(F.when(calling_code_length(value) > 0, calling_code_length(value) + 3).otherwise(3), F.length(digits))
        rest = random_digits(key.stream(tag(salt, "|phone.area"), digits, F.length(digits)), F.length(digits) - kept)
        other = put_digits(value, F.concat(F.substr(digits, F.lit(1), kept), rest))
        return F.coalesce(fictional_phone(key, value, salt, True), other)
    made = fictional_phone(key, value, salt, False)
    if row is not None and row.shaped:
        return made
    keep = calling_code_length(value) if mode_of(p2, "PRESERVE_COUNTRY") == "PRESERVE_COUNTRY" else 0
    return F.coalesce(made, keep_format(key, value, salt, keep))


def ssn_layout(digits: Column, layout: str, dashed: Column) -> Column:
    if layout == "DIGITS_ONLY":
        return digits
    split = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    if layout in ("DASHED", "PRESERVE_FORMAT"):
        return split
    return F.when(dashed, split).otherwise(digits)


def ssn(key, value, salt, p1=None, p2=None, row=None):
    mode, layout = mode_of(p1, "VALID_PRESERVE_AREA"), mode_of(p2, "PRESERVE_FORMAT")
    digits = only_digits(value)
    shaped = F.length(digits) == 9
    dashed = value.contains("-")

    def other() -> Column:
        return keep_format(key, value, salt)

    if mode == "FORMAT_PRESERVE":
        return other()
    if mode == "KEEP_LAST4":
        kept = ssn_layout(F.concat(F.lit("*****"), F.substring(digits, 6, 4)), layout, dashed)
        return or_else(shaped, kept, other, row)
    if mode == "REDACT":
        stars = F.when(dashed | F.lit(layout == "DASHED"), F.lit("***-**-****")).otherwise(F.lit("*********"))
        return or_else(shaped, stars, other, row)

    def build(d: Column) -> Column:
        draws = Draws(d)
        if mode == "VALID_RANDOM_AREA":
            number = 1 + draws.below(2, 898)
            area = F.lpad(F.when(number >= 666, number + 1).otherwise(number).cast("string"), 3, "0")
        else:
            own = F.substring(digits, 1, 3)
            area = F.when(own.isin("000", "666") | own.startswith("9"), F.lit("899")).otherwise(own)
        group = F.lpad((1 + draws.below(0, 99)).cast("string"), 2, "0")
        serial = F.lpad((1 + draws.below(1, 9999)).cast("string"), 4, "0")
        return ssn_layout(F.concat(area, group, serial), layout, dashed)

    return or_else(shaped, let(key.draws(tag(salt, "|ssn"), digits).digest, build), other, row)


def power_of_ten(exponent: Column) -> Column:
    """10**exponent as bigint, exponent 0..18."""
    return F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(19)]), (exponent + 1).cast("int"))


def permute_digits(key: MaskKey, digits: Column, salt: Column) -> Column:
    """Keyed one-to-one mapping of the digit strings of one length: eight add-modulo rounds on two halves."""
    size = F.length(digits)
    left_size = F.ceil(size / 2).cast("int")
    right_size = (size - left_size).cast("int")
    start = F.struct(
        F.substr(digits, F.lit(1), left_size).cast("bigint").alias("a"),
        F.coalesce(F.substr(digits, left_size + 1).try_cast("bigint"), F.lit(0).cast("bigint")).alias("b"),
    )

    def turn(state: Column, round_no: Column) -> Column:
        round_salt = F.concat(salt, F.lit("|round="), round_no.cast("string"))
        even = round_no % 2 == 0
        source = F.when(even, state["b"]).otherwise(state["a"])
        step = key.number(round_salt, source.cast("string"))
        a_mod, b_mod = power_of_ten(left_size), power_of_ten(right_size)
        return F.struct(
            F.when(even, (state["a"] + step % a_mod) % a_mod).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise((state["b"] + step % b_mod) % b_mod).alias("b"),
        )

    def text(state: Column) -> Column:
        left = F.lpad(state["a"].cast("string"), left_size, F.lit("0"))
        right = F.when(right_size > 0, F.lpad(state["b"].cast("string"), right_size, F.lit("0"))).otherwise("")
        return F.concat(left, right)

    rounds = F.array(*[F.lit(i) for i in range(8)])
    return F.when(size > 0, F.aggregate(rounds, start, turn, text)).otherwise(digits)


def card_layout(digits: Column, original: Column, layout: str) -> Column:
    if layout == "DIGITS_ONLY":
        return digits
    if layout in ("SPACES", "DASHES"):
        gap = " " if layout == "SPACES" else "-"
        return F.regexp_replace(digits, r"(.{4})(?=.)", f"$1{gap}")
    return put_digits(original, digits)


def card_keeping_last4(key: MaskKey, digits: Column, salt: Salt) -> Column:
    """Last four digits kept and the number valid again.

    All digits before the fifth-last are permuted; the fifth-last then has exactly one value that makes the check sum
    right. It is fixed by the other digits in source and result alike, so valid numbers still never collide.
    """
    tail = F.substring(digits, -4, 4)
    head = F.substr(digits, F.lit(1), F.length(digits) - 5)
    domain = F.concat(
        salt if isinstance(salt, Column) else F.lit(salt), F.lit("|keep-last4|length="),
        F.length(digits).cast("string"), F.lit("|tail="), tail,
    )

    def complete(new: Column) -> Column:
        rest = (F.lit(10) - luhn_sum(F.concat(new, F.lit("0"), tail), False) % 10) % 10
        return F.concat(new, rest.cast("string"), tail)

    return let(permute_digits(key, head, domain), complete)


def credit_card(key, value, salt, p1=None, p2=None, row=None):
    mode, layout = mode_of(p1, "VALID_PRESERVE_BIN"), mode_of(p2, "PRESERVE_FORMAT")

    if mode in ("VALID_RANDOM_BIN", "REDACT"):
        label = "|random-bin"
    else:
        label = "|format" if mode == "FORMAT_PRESERVE" else "|preserve-bin"

    def masked(digits: Column) -> Column:
        size, base = F.length(digits), salt if isinstance(salt, Column) else F.lit(salt)
        whole = F.concat(base, F.lit("|ccn-non-luhn|length="), size.cast("string"))

        def nonconform() -> Column:
            return keep_format(key, value, tag(salt, "|ccn-nonconform"))

        if mode in ("VALID_KEEP_LAST4", "KEEP_LAST4"):
            bad = permute_digits(key, digits, whole)
            full = F.when(luhn_valid(digits), card_keeping_last4(key, digits, salt)).otherwise(bad)
            return or_else(size.between(12, 19), card_layout(full, value, layout), nonconform, row)
        if mode in ("VALID_RANDOM_BIN", "REDACT"):
            kept = F.when(digits.rlike("^(3[47]|5[1-5])"), F.lit(2)).otherwise(F.lit(1))
        else:
            kept = F.lit(1 if mode == "FORMAT_PRESERVE" else 6)
        prefix = F.substr(digits, F.lit(1), kept)
        inner = F.substr(digits, kept + 1, size - kept - 1)
        domain = F.concat(base, F.lit(f"{label}|length="), size.cast("string"), F.lit("|prefix="), prefix)

        def full_number(valid: Column) -> Column:
            # A valid number keeps its prefix and gets a new check digit; other digits are permuted as a whole.
            mixed = permute_digits(key, F.when(valid, inner).otherwise(digits), F.when(valid, domain).otherwise(whole))
            body = let(F.concat(prefix, mixed), lambda b: F.concat(b, luhn_digit(b)))
            return card_layout(F.when(valid, body).otherwise(mixed), value, layout)

        if row is not None and row.shaped:
            body = let(F.concat(prefix, permute_digits(key, inner, domain)), lambda b: F.concat(b, luhn_digit(b)))
            return card_layout(body, value, layout)
        return or_else(size.between(12, 19), let(luhn_valid(digits), full_number), nonconform, row)

    return let(only_digits(value), masked)


# ---------------------------------------------------------------- dates

JULIAN = {"YYYYDDD", "JULIAN"}
JULIAN_SHORT = {"YYDDD": 2000, "CYYDDD": 1900, "JDE": 1900}


def parsed_date(text: Column, fmt: str | None) -> Column:
    """Date in a text, null when it is none. Without a format ISO, d/m/y and year-day forms are recognised."""
    def julian(year: Column, day: Column) -> Column:
        first = F.make_date(year, F.lit(1), F.lit(1))
        found = F.date_add(first, day - 1)
        return F.when((day >= 1) & (F.year(found) == year), found)

    if fmt and fmt.strip():
        name = fmt.strip().upper()
        if name in JULIAN:
            shaped = text.rlike(r"^\d{7}$")
            return F.when(shaped, julian(F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 3).try_cast("int")))
        if name in JULIAN_SHORT:
            width = 2 if name == "YYDDD" else 3
            shaped = text.rlike(rf"^\d{{{width + 3}}}$")
            year = JULIAN_SHORT[name] + F.substring(text, 1, width).try_cast("int")
            return F.when(shaped, julian(year, F.substring(text, width + 1, 3).try_cast("int")))
        return F.try_to_timestamp(text, F.lit(fmt.strip())).cast("date")
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return (
        F.when(iso, text.try_cast("date"))
        .when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"))
        .when(text.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(text, F.lit("dd-MM-yyyy")).cast("date"))
        .when(
            text.rlike(r"^(19|20)\d{5}$"),
            julian(F.substring(text, 1, 4).try_cast("int"), F.substring(text, 5, 3).try_cast("int")),
        )
    )


def date_text(day: Column, source: Column, fmt: str | None) -> Column:
    """A date in the form of the source text."""
    year_day = F.concat(F.date_format(day, "yyyy"), F.lpad(F.dayofyear(day).cast("string"), 3, "0"))
    if fmt and fmt.strip():
        name = fmt.strip().upper()
        if name in JULIAN:
            return year_day
        if name == "YYDDD":
            return F.substr(year_day, F.lit(3))
        if name in JULIAN_SHORT:
            return F.concat(F.lpad((F.year(day) - 1900).cast("string"), 3, "0"), F.substr(year_day, F.lit(5)))
        return F.date_format(day, fmt.strip())
    return (
        F.when(source.rlike(r"^\d{4}-"), F.date_format(day, "yyyy-MM-dd"))
        .when(source.rlike(r"^\d{2}/"), F.date_format(day, "dd/MM/yyyy"))
        .when(source.rlike(r"^\d{2}-"), F.date_format(day, "dd-MM-yyyy"))
        .otherwise(year_day)
    )


def with_date(value: Column, fmt: str | None, change: Callable[[Column], Column]) -> Column:
    """Change the date part of a text; a time suffix stays and text without a date is unchanged."""
    clean = F.trim(value)
    part, suffix = F.substring(clean, 1, 10), F.substr(clean, F.lit(11))

    def rewrite(day: Column) -> Column:
        return F.when(day.isNull(), value).otherwise(F.concat(date_text(change(day), part, fmt), suffix))

    return let(parsed_date(part, fmt), rewrite)


def shift_range(spec: str | None) -> tuple[int, int]:
    text = spec.strip() if spec and spec.strip() else "365"
    if ":" not in text:
        days = abs(int(text))
        return -days, days
    low, high = (int(x) for x in text.split(":"))
    if low > high:
        raise ValueError("DATE_SHIFT minimum days must be <= maximum days")
    return low, high


def shared_range(specs: list[str | None]) -> tuple[int, int] | None:
    """Common range of two or more shifted columns of one row."""
    if len(specs) < 2:
        return None
    ranges = [shift_range(s) for s in specs]
    low, high = max(r[0] for r in ranges), min(r[1] for r in ranges)
    if low > high:
        raise ValueError("DATE_SHIFT ranges on related columns do not overlap")
    return low, high


def shift_days(number: Column, low: int, high: int) -> Column:
    days = F.lit(low) + number % F.lit(high - low + 1).cast("bigint")
    if low == 0 and high == 0:
        return days.cast("int")
    return F.when(days == 0, F.lit(1 if high > 0 else -1)).otherwise(days).cast("int")


def row_shift(key: MaskKey, columns: Mapping[str, Column], low: int, high: int) -> Column:
    """One shift per row, from all its columns in name order."""
    pairs = [
        F.concat(F.lit(f"{name}="), F.coalesce(columns[name].cast("string"), F.lit("null")))
        for name in sorted(columns)
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return shift_days(key.number("row|dshift", text), low, high)


def date_shift(key, value, salt, p1=None, p2=None, row=None):
    if row is not None and row.shared_shift is not None:
        days = row.shared_shift
    else:
        low, high = shift_range(p1)
        days = shift_days(key.number(tag(salt, "|dshift"), value), low, high)
    return with_date(value, p2, lambda day: F.date_add(day, days))


def shifted(key: MaskKey, value: Column, text: Column, salt: Salt, spec: str | None, row: Row | None) -> Column:
    """DATE_SHIFT of a date or timestamp column without the way through text; same days as the text form."""
    if row is not None and row.shared_shift is not None:
        days = row.shared_shift
    else:
        days = shift_days(key.number(tag(salt, "|dshift"), text), *shift_range(spec))
    return value + F.make_dt_interval(days=days)


def dob_age_band(key, value, salt, p1=None, p2=None, row=None):
    band = max(1, int(p1)) if p1 and re.fullmatch(r"\s*-?\d+\s*", p1) else 5
    digest = key.draws(tag(salt, "|dob"), value).digest

    def inside(day: Column) -> Column:
        draws = Draws(digest)
        start = F.year(day) - F.pmod(F.year(day), F.lit(band))
        return F.make_date(
            (start + draws.below(0, band)).cast("int"), (1 + draws.below(1, 12)).cast("int"),
            (1 + draws.below(2, 28)).cast("int"),
        )

    return with_date(value, p2, inside)


def age(key, value, salt, p1=None, p2=None, row=None):
    tokens = re.findall(r"([+-]?\d+)\s*([ymwd])", p1 or "", re.I)
    if not tokens:
        raise ValueError('AGE needs a shift such as "+1y -2m +10d"')
    total = {u: sum(int(n) for n, unit in tokens if unit.lower() == u) for u in "ymwd"}

    def moved(day: Column) -> Column:
        out = F.add_months(F.add_months(day, total["y"] * 12), total["m"])
        return F.date_add(out, total["w"] * 7 + total["d"])

    return with_date(value, p2, moved)


# ---------------------------------------------------------------- addresses

def street_line(key: MaskKey, value: Column, salt: Salt) -> Column:
    def build(d: Column) -> Column:
        draws = Draws(d)
        number = (1 + draws.below(0, 9899)).cast("string")
        return F.concat(number, F.lit(" "), words.street(draws.below(1, words.STREET_SIZE)))

    return let(key.draws(tag(salt, "|street"), normalise(value)).digest, build)


def address_street(key, value, salt, p1=None, p2=None, row=None):
    return in_case(street_line(key, value, salt), case_of(p2, p1))


def kept_state(value: Column, row: Row | None) -> Column:
    """State code found in the value or in a sibling column, else null."""
    clean = F.upper(F.trim(value))
    found = F.filter(
        F.regexp_extract_all(clean, F.lit(r"(?:^|[\s,])([A-Z]{2})(?=\s+\d{5}|[\s,]|$)"), F.lit(1)),
        lambda s: s.isin(*words.STATES),
    )
    out = F.get(found, F.lit(0))
    columns = row.columns if row else {}
    countries = [columns[c].cast("string") for c in ("country", "country_code") if c in columns]
    for name in ("state", "state_code", "province", "region", "billing_state", "shipping_state"):
        if name in columns:
            own = F.upper(F.trim(columns[name].cast("string")))
            good = own.isin(*words.STATES)
            for country in countries:
                home = F.upper(F.regexp_replace(F.trim(country), r"\.", ""))
                good = good & F.coalesce(
                    home.isin("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"), F.lit(True)
                )
            out = F.coalesce(out, F.when(good, own))
    return out


def city_row(key: MaskKey, value: Column, mode: str | None, row: Row | None) -> Column:
    """Coherent ``city,state,zip`` text."""
    clean = normalise(value)
    free = key.pick("geo.triplet|any", clean, words.CITIES)
    if mode_of(mode, "") != "PRESERVE_STATE":
        return free
    by_state = F.create_map(
        *[
            part
            for state in words.STATES
            for part in (F.lit(state), F.array(*[F.lit(c) for c in words.CITIES if c.split(",")[1] == state]))
        ]
    )

    def choose(state: Column) -> Column:
        options = F.element_at(by_state, state)
        place = key.number(F.concat(F.lit("geo.triplet|"), state), clean) % F.size(options)
        return F.when(state.isNull(), free).otherwise(F.element_at(options, (place + 1).cast("int")))

    return let(kept_state(value, row), choose)


def city_state_zip(key, value, salt, p1=None, p2=None, row=None):
    part = mode_of(p1, "FULL")

    def emit(text: Column) -> Column:
        cells = F.split(text, ",")
        city, state, code = cells[0], cells[1], cells[2]
        if part in ("CITY", "STATE", "ZIP"):
            return {"CITY": city, "STATE": state, "ZIP": code}[part]
        return F.concat(city, F.lit(", "), state, F.lit(" "), code)

    return let(city_row(key, value, p2, row), emit)


def address_us(key, value, salt, p1=None, p2=None, row=None):
    part = mode_of(p1, "FULL")
    line1 = street_line(key, value, tag(salt, ".line1"))
    unit = (100 + key.draws(tag(salt, "|line2"), normalise(value)).below(0, 899)).cast("string")
    line2 = F.concat(F.lit("Apt "), unit)
    if part in ("LINE1", "STREET", "ADDRESS1", "ADDRESS_LINE1"):
        return line1
    if part in ("LINE2", "ADDRESS2", "ADDRESS_LINE2"):
        return line2
    if part == "COUNTRY":
        return F.lit("USA")
    if part in ("CITY", "STATE", "ZIP", "POSTAL", "POSTAL_CODE"):
        return city_state_zip(key, value, salt, "ZIP" if part.startswith("POSTAL") else part, p2, row)
    place = city_state_zip(key, value, salt, "FULL", p2, row)
    return F.concat_ws(", ", line1, line2, place, F.lit("USA"))


# ---------------------------------------------------------------- tokens, lookups, redaction

def format_preserve(key, value, salt, p1=None, p2=None, row=None):
    return in_case(keep_format(key, value, salt), case_of(p2, p1))


def character_mapping(key, value, salt, p1=None, p2=None, row=None):
    return in_case(character_map(key, value, salt, p1), case_of(p2))


def tokenize(key, value, salt, p1=None, p2=None, row=None):
    prefix = "TKN_" if p1 is None else "" if p1.upper() == "NONE" else p1
    length = max(12, min(64, int(p2))) if p2 and re.fullmatch(r"\s*\d+\s*", p2) else 32
    return F.concat(F.lit(prefix), F.substring(key.digest(tag(salt, "|token"), normalise(value)), 1, length))


def list_entries(definition: str) -> list[str]:
    """Usable entries of a pipe list; a ``:weight`` tail is dropped."""
    entries = [e.strip() for e in definition.split("|") if e.strip()]
    return [re.sub(r"^(.+):\s*\d+\s*$", r"\1", e).strip() for e in entries]


def secure_lookup(key, value, salt, p1=None, p2=None, row=None):
    values = list_entries(p1 or "")
    if not values:
        raise ValueError("SECURE_LOOKUP has no usable replacement values")
    return in_case(key.pick(tag(salt, "|secure-lookup"), normalise(value), values), case_of(p2))


def hash_lov(key, value, salt, p1=None, p2=None, row=None):
    """Pick from a named list given as pipe text; without one from the first names."""
    if not p1:
        return in_case(first_pick(key, salt, value), case_of(p2))
    return in_case(key.pick(tag(salt, f"|{p1}"), normalise(value), list_entries(p1)), case_of(p2))


def lookup_options(spec: str | None) -> dict[str, str]:
    options = {}
    for part in (spec or "").split(";"):
        if part.strip():
            name, _, text = part.partition("=")
            options[name.strip().upper()] = text.strip() if "=" in part else "TRUE"
    return options


def lookup_source(value: Column, options: dict[str, str], row: Row | None) -> Column:
    if not options.get("SOURCE"):
        return value
    if row is None:
        raise ValueError("lookup SOURCE columns need the row")
    cells = [F.coalesce(row.original(c), F.lit("<NULL>")) for c in options["SOURCE"].split(",") if c.strip()]
    return F.concat_ws(options.get("JOIN", "~"), *cells)


def lookup_key(value: Column, options: dict[str, str]) -> Column:
    out = value
    trim = options.get("TRIM", "NONE").upper()
    if trim in ("TRUE", "BOTH"):
        out = F.trim(out)
    elif trim == "LEFT":
        out = F.regexp_replace(out, r"^\s+", "")
    elif trim == "RIGHT":
        out = F.regexp_replace(out, r"\s+$", "")
    if options.get("TRIM_CHARS"):
        out = F.translate(out, options["TRIM_CHARS"].replace("<SPACE>", " "), "")
    case = options.get("CASE", "UPPER" if "UPPER" in options else "SENSITIVE").upper()
    if case in ("UPPER", "INSENSITIVE"):
        return F.upper(out)
    return F.lower(out) if case == "LOWER" else out


def lookup_fallback(action: str, value: Column, options: dict[str, str], message: str) -> Column:
    action = action.strip().upper()
    if action in ("PRESERVE", "IGNORE"):
        return value
    if action in ("NULL", "NULLIFY"):
        return F.lit(None).cast("string")
    if action == "REDACT":
        return keep_ends(value, "*", 0, 0)
    if action == "DEFAULT":
        return F.lit(options["DEFAULT"])
    if action == "ERROR":
        return F.raise_error(F.lit(message)).cast("string")
    raise ValueError(f"unknown lookup fallback action: {action}")


def lookup_pairs(definition: str) -> list[tuple[str, str]]:
    pairs = []
    for part in definition.split("|"):
        if part.strip():
            left, found, right = part.partition("=>") if "=>" in part else part.partition("=")
            if not found:
                raise ValueError("lookup entries must use source=>replacement pairs")
            pairs.append((left.strip(), right.strip()))
    return pairs


def direct_lookup(key, value, salt, p1=None, p2=None, row=None):
    options = lookup_options(p2)
    case = options.get("CASE", "UPPER" if "UPPER" in options else "SENSITIVE").upper()
    pairs: dict[str, str] = {}
    for left, right in lookup_pairs(p1 or ""):
        name = left.upper() if case in ("UPPER", "INSENSITIVE") else left.lower() if case == "LOWER" else left
        if left.upper() in ("<NULL>", "<EMPTY>", "<SPACES>"):
            name = left.upper()
        if name in pairs:
            raise ValueError("DIRECT_LOOKUP contains duplicate keys after trim/case rules")
        pairs[name] = right
    source = lookup_source(value, options, row)
    wanted = (
        F.when(source.isNull(), F.lit("<NULL>")).when(source == "", F.lit("<EMPTY>"))
        .when(F.trim(source) == "", F.lit("<SPACES>")).otherwise(lookup_key(source, options))
    )
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    missing = lookup_fallback(options.get("NOT_FOUND", "ERROR"), value, options, "DIRECT_LOOKUP found no matching key")
    return let(
        F.try_element_at(table, wanted),
        lambda hit: F.when(hit.isNotNull(), in_case(hit, options.get("OUTPUT"))).otherwise(missing),
    )


def hash_lookup(key, value, salt, p1=None, p2=None, row=None):
    """Value hashed to row 1..N of a list; rows -1/-2/-3 serve null, blank and empty input."""
    options = lookup_options(p2)
    definition = p1 or ""
    reserved: dict[int, str] = {}
    if re.search(r"(?:^|\|)\s*-?\d+\s*=", definition):
        numbered = {int(left): right for left, right in lookup_pairs(definition)}
        reserved = {k: v for k, v in numbered.items() if k < 0}
        size = len(numbered) - len(reserved)
        if sorted(k for k in numbered if k > 0) != list(range(1, size + 1)):
            raise ValueError("HASH_LOOKUP positive keys must run from 1 without gaps")
        values = [numbered[i] for i in range(1, size + 1)]
    else:
        values = list_entries(definition)
    if not values:
        raise ValueError("HASH_LOOKUP has no replacement rows")

    def cell(text: str) -> str:
        if not options.get("VALUE"):
            return text
        return text.split(options.get("VCOLSEP", "~"))[int(options["VALUE"]) - 1].strip()

    def special(code: int, option: str) -> Column:
        if code in reserved:
            return in_case(F.lit(cell(reserved[code])), options.get("OUTPUT"))
        return lookup_fallback(options.get(option, "ERROR"), value, options, f"HASH_LOOKUP needs reserved key {code}")

    identity = definition.strip()
    mark = hmac.new(key.secret.encode(), b"lookup-definition\x1f" + identity.encode(), hashlib.sha256).hexdigest()[:16]
    salt_text = f"hash-lookup|inline:{mark}|seed={options.get('SEED', '0')}"
    source = lookup_source(value, options, row)
    prepared = lookup_key(source, options)
    picked = in_case(key.pick(salt_text, prepared, [cell(v) for v in values]), options.get("OUTPUT"))
    return (
        F.when(source.isNull(), special(-1, "NULL")).when(source == "", special(-3, "ZERO_LEN"))
        .when((F.trim(source) == "") | (prepared == ""), special(-2, "SPACES")).otherwise(picked)
    )


def redact(key, value, salt, p1=None, p2=None, row=None):
    mask = p1[0] if p1 else "*"
    mode = mode_of(p2, "FULL")
    number = re.search(r":\s*(\d+)\s*$", mode)
    if mode.startswith("STANDARD:"):
        return F.lit(mask * (int(number.group(1)) if number else 8))
    if mode == "FULL":
        return F.repeat(F.lit(mask), F.length(value))
    count = int(number.group(1)) if number else 0
    first = 2 if mode in ("KEEP_FIRST2", "KEEP_FIRST2_LAST4") else count if mode.startswith("KEEP_FIRST:") else 0
    last = 4 if mode in ("KEEP_LAST4", "KEEP_FIRST2_LAST4") else count if mode.startswith("KEEP_LAST:") else 0
    return keep_ends(value, mask, first, last)


def redact_keep_last4(key, value, salt, p1=None, p2=None, row=None):
    """The function's form: at most twelve stars, then the last four characters."""
    size = F.length(value)
    stars = F.repeat(F.lit("*"), F.least(size - 4, F.lit(12)))
    return F.when(size <= 4, F.lit("****")).otherwise(F.concat(stars, F.substring(value, -4, 4)))


# ---------------------------------------------------------------- numbers

NUMBER = "decimal(28,8)"


def decimal_places(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1))


def with_places(number: Column, places: Column) -> Column:
    """Decimal as plain text with a per-row number of places (at most eight), rounded half up."""
    scale = F.pow(F.lit(10), places).cast("decimal(10,0)")
    units = F.round(number * scale, 0).cast("decimal(38,0)")
    plain = F.lpad(F.abs(units).cast("string"), F.greatest(F.length(F.abs(units).cast("string")), places + 1), F.lit("0"))
    whole = F.substr(plain, F.lit(1), F.length(plain) - places)
    sign = F.when(units < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(places > 0, F.concat(sign, whole, F.lit("."), F.substr(plain, F.length(plain) - places + 1))).otherwise(
        F.concat(sign, whole)
    )


def numeric_noise(key, value, salt, p1=None, p2=None, row=None):
    spec = mode_of(p1, "PERCENT:10")
    if not spec.startswith(("PERCENT", "ABS")):
        raise ValueError("NUMERIC_NOISE param1 must be PERCENT:n or ABS:n")
    amount = abs(float(spec.split(":", 1)[1])) if ":" in spec else 10.0
    clean = F.trim(value)
    places = F.least(decimal_places(clean), F.lit(8))
    share = F.round(F.lit(2.0) * key.draws(tag(salt, "|numeric-noise"), normalise(value)).unit(0) - 1.0, 8).cast("decimal(10,8)")

    def noisy(number: Column) -> Column:
        reach = F.lit(amount).cast("decimal(18,6)") if spec.startswith("ABS") else (
            F.abs(number) * F.lit(amount / 100.0).cast("decimal(9,6)")
        ).cast(NUMBER)
        out = (number + (reach * share).cast(NUMBER)).cast(NUMBER)
        if p2 and p2.strip():
            low, high = p2.split(":")
            out = F.greatest(F.lit(low.strip()).cast(NUMBER), F.least(F.lit(high.strip()).cast(NUMBER), out))
        other = character_map(key, value, tag(salt, "|numeric-fallback"))
        return F.when(number.isNull(), other).otherwise(with_places(out, places))

    return let(clean.try_cast(NUMBER), noisy)


def min_max(key, value, salt, p1=None, p2=None, row=None):
    low, high = F.lit(str(p1).strip()).cast(NUMBER), F.lit(str(p2).strip()).cast(NUMBER)
    if float(p1) > float(p2):
        raise ValueError("MIN_MAX param1 must be <= param2")
    share = F.round(key.draws(tag(salt, "|min-max"), normalise(value)).unit(0), 8).cast("decimal(10,8)")
    out = (low + ((high - low).cast(NUMBER) * share).cast(NUMBER)).cast(NUMBER)
    places = F.least(decimal_places(F.trim(value)), F.lit(8))
    checked = F.when(F.trim(value).try_cast(NUMBER).isNull(), F.raise_error(F.lit("MIN_MAX needs numeric values")).cast(NUMBER))
    return with_places(F.coalesce(checked, out), places)


# ---------------------------------------------------------------- bank and network identifiers

def bank_account(key, value, salt, p1=None, p2=None, row=None):
    mode = mode_of(p1, "KEEP_LAST4")
    if mode == "REDACT":
        return keep_ends(value, "*", 0, 0)
    if mode == "FORMAT_PRESERVE":
        return keep_format(key, value, tag(salt, "|account"))
    digits = only_digits(value)
    changed = F.greatest(F.length(digits) - 4, F.lit(0))
    new = let(
        key.stream(tag(salt, "|account"), digits, F.greatest(F.length(digits), F.lit(1))),
        lambda s: random_digits(s, changed),
    )
    full = put_digits(value, F.concat(new, F.substr(digits, changed + 1)))
    return F.when(digits == "", character_map(key, value, tag(salt, "|account"))).otherwise(full)


def random_shape(stream: Column, shape: Column, first: Column | int = 0) -> Column:
    """Random letter for each letter and digit for each digit of an upper-case text."""
    return F.array_join(
        F.transform(
            characters(shape),
            lambda c, i: F.when(c.rlike("^[A-Z]$"), F.char(65 + stream_draw(stream, i + first, 26))).otherwise(
                F.char(48 + stream_draw(stream, i + first, 10))
            ),
        ),
        "",
    )


SAFE_IBAN_COUNTRIES = ["GB", "DE", "FR", "ES", "IT", "NL"]
SAFE_BIC_COUNTRIES = ["US", "GB", "DE", "FR", "CA", "AU"]


def iban(key, value, salt, p1=None, p2=None, row=None):
    def masked(compact: Column) -> Column:
        shaped = F.length(compact).between(15, 34) & compact.rlike("^[A-Z]{2}")
        country = F.substring(compact, 1, 2)
        if mode_of(p1, "") == "RANDOM_COUNTRY":
            country = key.pick(tag(salt, "|iban-country"), compact, SAFE_IBAN_COUNTRIES)
        bban = let(
            key.stream(tag(salt, "|iban"), compact, F.length(compact)),
            lambda s: random_shape(s, F.substr(compact, F.lit(5))),
        )

        def build(body: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            made = F.concat(country, check, body)
            return made if mode_of(p2, "") == "COMPACT" else put_alnum(value, made)

        return or_else(shaped, let(bban, build), lambda: character_map(key, value, tag(salt, "|iban-fallback")), row)

    return let(only_alnum(value), masked)


def swift_bic(key, value, salt, p1=None, p2=None, row=None):
    def masked(compact: Column) -> Column:
        shaped = compact.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")

        def build(stream: Column) -> Column:
            letters = F.concat(*[F.char(65 + stream_draw(stream, F.lit(i), 26)) for i in range(4)])
            if mode_of(p1, "") == "RANDOM_COUNTRY":
                country = at(SAFE_BIC_COUNTRIES, stream_draw(stream, F.lit(4), 6))
            else:
                country = F.substring(compact, 5, 2)

            def mixed(i: Column) -> Column:
                return let(stream_draw(stream, i + 5, 36), lambda n: F.when(n < 26, F.char(65 + n)).otherwise(F.char(22 + n)))

            tail = F.array_join(F.transform(count_to(F.length(compact) - 6), mixed), "")
            return F.concat(letters, country, tail)

        made = let(key.stream(tag(salt, "|bic"), compact, F.lit(16)), build)
        return or_else(shaped, made, lambda: character_map(key, value, tag(salt, "|bic-fallback")), row)

    return let(F.upper(F.regexp_replace(value, r"\s", "")), masked)


ABA_PREFIXES = [f"{n:02d}" for n in (*range(1, 13), *range(21, 33))]


def aba_body(prefix: Column, draws: Draws, first: int) -> Column:
    """Eight digits plus their 3-7-1 check digit."""
    body = F.concat(prefix, draws.digits(first, 6))
    check = (10 - weighted_digit_sum(body, [3, 7, 1, 3, 7, 1, 3, 7]) % 10) % 10
    return F.concat(body, check.cast("string"))


def aba_routing(key, value, salt, p1=None, p2=None, row=None):
    digits = only_digits(value)

    def build(d: Column) -> Column:
        draws = Draws(d)
        prefix = draws.choice(0, ABA_PREFIXES)
        if mode_of(p1, "") == "PRESERVE_FED_DISTRICT":
            own = F.substring(digits, 1, 2).try_cast("int")
            valid = own.between(0, 12) | own.between(21, 32) | own.between(61, 72) | (own == 80)
            prefix = F.when(valid, F.substring(digits, 1, 2)).otherwise(prefix)
        return put_digits(value, aba_body(prefix, draws, 1))

    made = let(key.draws(tag(salt, "|aba"), digits).digest, build)
    return F.when(F.length(digits) == 9, made).otherwise(keep_format(key, value, tag(salt, "|aba-fallback")))


UK_LETTERS = list("ABCEGHJKLMNPRSTWXYZ")


def national_id(key, value, salt, p1=None, p2=None, row=None):
    country = mode_of(p1, "GENERIC")
    if country == "US":
        return ssn(key, value, tag(salt, "|nid.us"), "VALID_RANDOM_AREA", p2)
    other = character_map(key, value, tag(salt, "|nid.generic"))
    compact = only_alnum(value)
    digest = key.draws(tag(salt, f"|nid.{country.lower()}"), compact).digest
    if country == "CA":
        made = let(
            digest, lambda d: let(Draws(d).digits(0, 8), lambda b: put_digits(value, F.concat(b, luhn_digit(b))))
        )
        return F.when(compact.rlike(r"^\d{9}$"), made).otherwise(other)
    if country == "UK":
        def build(d: Column) -> Column:
            draws = Draws(d)
            text = F.concat(
                draws.choice(0, UK_LETTERS), draws.choice(1, UK_LETTERS), draws.digits(2, 6), draws.choice(3, list("ABCD"))
            )
            return put_alnum(value, text)

        return F.when(compact.rlike(r"^[A-Z]{2}\d{6}[A-D]$"), let(digest, build)).otherwise(other)
    return other


DOCUMENTATION_NETS = ["192.0.2", "198.51.100", "203.0.113"]


def ip_address(key, value, salt, p1=None, p2=None, row=None):
    clean = F.trim(value)
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0*[0-9]{1,2})"
    v4 = clean.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    v6 = clean.contains(":") & clean.rlike("^[0-9A-Fa-f:]+$")

    def build(d: Column) -> Column:
        draws = Draws(d)
        host = (1 + draws.below(2, 254)).cast("string")
        b1, b2 = draws.below(0, 256).cast("string"), draws.below(1, 256).cast("string")
        groups = [F.lower(F.hex(draws.below(i, 65536))) for i in range(6)]
        six = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *groups))
        public = F.concat_ws(".", draws.choice(3, DOCUMENTATION_NETS), host)
        out = F.when(v6, six).when(~v4, F.lit(None).cast("string"))
        if mode_of(p1, "") != "SAFE_TEST_RANGE":
            first, second = F.split(clean, r"\.")[0].try_cast("int"), F.get(F.split(clean, r"\."), F.lit(1)).try_cast("int")
            out = (
                out.when(first == 10, F.concat_ws(".", F.lit("10"), b1, b2, host))
                .when(
                    (first == 172) & second.between(16, 31),
                    F.concat_ws(".", F.lit("172"), (16 + draws.below(0, 16)).cast("string"), b2, host),
                )
                .when((first == 192) & (second == 168), F.concat_ws(".", F.lit("192.168"), b2, host))
            )
        return out.otherwise(public)

    made = let(key.draws(tag(salt, "|ip"), F.lower(clean)).digest, build)
    if row is not None and row.shaped:
        return made
    return F.coalesce(made, character_map(key, value, tag(salt, "|ip-fallback")))


def mac_address(key, value, salt, p1=None, p2=None, row=None):
    compact = F.lower(F.regexp_replace(value, "[:-]", ""))
    gap = F.when(value.contains("-"), F.lit("-")).otherwise(F.lit(":"))

    def build(d: Column) -> Column:
        if mode_of(p1, "") == "PRESERVE_OUI":
            text = F.concat(F.substring(compact, 1, 6), F.substring(d, 7, 6))
        else:
            local = F.translate(F.substring(d, 2, 1), "0123456789abcdef", "2222666aaaa6eeee")
            text = F.concat(F.substring(d, 1, 1), local, F.substring(d, 3, 10))
        pairs = F.array(*[F.substring(text, 2 * i + 1, 2) for i in range(6)])
        out = F.aggregate(F.slice(pairs, 2, 5), F.element_at(pairs, 1), lambda a, b: F.concat(a, gap, b))
        return F.when(value == F.upper(value), F.upper(out)).otherwise(out)

    made = let(key.draws(tag(salt, "|mac"), compact).digest, build)
    return or_else(
        compact.rlike("^[0-9a-f]{12}$"), made, lambda: character_map(key, value, tag(salt, "|mac-fallback")), row
    )


def uuid_shape(digest: Column) -> Column:
    """Version-4 shaped UUID from the first 16 bytes of a digest."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("4"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def uuid(key, value, salt, p1=None, p2=None, row=None):
    compact = F.lower(F.regexp_replace(value, "[{}-]", ""))

    def build(d: Column) -> Column:
        plain = uuid_shape(d)
        cased = F.when(value == F.upper(value), F.upper(plain)).otherwise(plain)
        braced = value.startswith("{") & value.endswith("}")
        return F.when(braced, F.concat(F.lit("{"), cased, F.lit("}"))).otherwise(cased)

    made = let(key.digest(tag(salt, "|uuid"), compact), build)
    other = character_map(key, value, tag(salt, "|uuid-fallback"))
    return F.when(compact.rlike("^[0-9a-f]{32}$"), made).otherwise(other)


# ---------------------------------------------------------------- row-aware and composed masks

def by_indicator(key, value, salt, p1=None, p2=None, row=None):
    """Function chosen per row by another column: ``P=PHONE|E=EMAIL|*=FORMAT_PRESERVE``."""
    if not p1 or not p2 or row is None:
        return value
    indicator = F.lower(F.trim(F.coalesce(row.original(p1), F.lit(""))))
    rules, default = [], value
    for part in p2.split("|"):
        name, found, fn = (x.strip() for x in part.partition("="))
        if not found or fn.upper() not in MASKS or fn.upper() == "BY_INDICATOR":
            continue
        masked = mask(fn, value, key, SALTS.get(fn.upper(), salt))
        if name == "*":
            default = masked
        else:
            rules.append((name.lower(), masked))
    out = None
    for name, masked in rules:
        out = F.when(indicator == name, masked) if out is None else out.when(indicator == name, masked)
    return default if out is None else out.otherwise(default)


def partial_mask(key, value, salt, p1=None, p2=None, row=None):
    """Mask only the matches of a pattern (default letter runs as names) and keep their letter case."""
    pattern = p1 if p1 and p1.strip() else "[A-Za-z]+"
    fn = mode_of(p2, "FIRST_NAME")
    if fn not in MASKS or fn in ("PARTIAL_MASK", "BY_INDICATOR"):
        return value
    inner = SALTS.get(fn, salt)
    return replace_matches(
        value, pattern, lambda m: like_source_case(m, F.coalesce(mask(fn, m, key, inner), F.lit("")))
    )


def split_digits(key: MaskKey, value: Column, own: str | None, columns: str | None, row: Row | None, whole: str) -> Column:
    """Mask the number spread over several columns once and return this column's slice of it."""
    names = [c.strip() for c in (columns or "").split(",") if c.strip()]
    if not own or row is None or own.strip().lower() not in [n.lower() for n in names]:
        return value
    cells = [
        only_digits(value if n.lower() == own.strip().lower() else F.coalesce(row.original(n), F.lit(""))) for n in names
    ]
    place = [n.lower() for n in names].index(own.strip().lower())
    before = F.length(F.concat(*cells[:place])) if place else F.lit(0)
    joined = F.concat(*cells)
    if whole == "ssn":
        masked = only_digits(ssn(key, joined, "ssn", None, "DIGITS_ONLY"))
    else:
        masked = F.coalesce(fictional_digits(key, joined, "phone", False), keep_format(key, joined, "phone"))

    def slice_of(text: Column) -> Column:
        own_part = F.substr(text, before + 1, F.length(cells[place]))
        fits = F.length(text) == F.length(joined)
        return F.when(fits, put_digits(value, own_part)).otherwise(keep_format(key, value, f"{whole}|split"))

    return F.when(cells[place] == "", value).otherwise(let(masked, slice_of))


def phone_split(key, value, salt, p1=None, p2=None, row=None):
    return split_digits(key, value, p1, p2, row, "phone")


def ssn_split(key, value, salt, p1=None, p2=None, row=None):
    return split_digits(key, value, p1, p2, row, "ssn")


def date_split(key, value, salt, p1=None, p2=None, row=None):
    """Day, month and year columns masked as one date of birth; each column keeps its zero padding."""
    roles = {}
    for part in (p2 or "").split(","):
        role, found, name = (x.strip() for x in part.partition("="))
        if found:
            roles["yyyy" if role.lower() == "yy" else role.lower()] = name
    own = (p1 or "").strip().lower()
    if row is None or not {"dd", "mm", "yyyy"} <= set(roles) or own not in [n.lower() for n in roles.values()]:
        return value
    cell = {r: F.trim(value if n.lower() == own else row.original(n)) for r, n in roles.items()}
    iso = F.concat_ws(
        "-", F.lpad(cell["yyyy"], 4, "0"), F.lpad(cell["mm"], 2, "0"), F.lpad(cell["dd"], 2, "0")
    )
    whole = F.coalesce(cell["dd"], cell["mm"], cell["yyyy"]).isNotNull()
    day = F.when(whole, dob_age_band(key, iso, "dob", "5", "yyyy-MM-dd")).try_cast("date")
    role = next(r for r, n in roles.items() if n.lower() == own)
    number = {"dd": F.dayofmonth(day), "mm": F.month(day), "yyyy": F.year(day)}[role].cast("string")
    width = F.length(F.trim(value))
    padded = number if role == "yyyy" else F.when(width >= 2, F.lpad(number, width, F.lit("0"))).otherwise(number)
    return F.when(iso.try_cast("date").isNull(), value).otherwise(padded)


# ---------------------------------------------------------------- SWIFT messages

# Message tags that carry a party name or a reference.
PARTY_TAGS = ["50", "50A", "50F", "50K", "59", "59A", "59F", "52D", "53D", "54D", "55D", "56D", "57D", "58D"]
REFERENCE_TAGS = ["20", "21", "108", "121"]
BIC_LINE = r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"


def swift_mt(key, value, salt, p1=None, p2=None, row=None):
    """FIN message with BICs, accounts, first party line and references masked; amounts and dates stay."""

    def head(block: str, lead: int) -> Callable[[Column], Column]:
        def change(text: Column) -> Column:
            kept = F.substr(text, F.lit(1), F.lit(3 + lead))
            bic = swift_bic(key, F.substr(text, F.lit(4 + lead), F.lit(8)), tag(salt, ":hdr"))
            return F.concat(kept, bic)

        return change

    def field_value(name: Column, text: Column) -> Column:
        own = F.concat(salt if isinstance(salt, Column) else F.lit(salt), F.lit(":"), name)
        known = Row(shaped=True)

        def account_line(account: Column, own: Column) -> Column:
            return F.concat(
                F.lit("/"),
                F.when(account.rlike("^[A-Z]{2}[0-9]{2}[A-Za-z0-9]{11,30}$"), iban(key, account, own, row=known)).otherwise(
                    bank_account(key, account, own, "FORMAT_PRESERVE")
                ),
            )

        def masked_lines(field: Column) -> Column:
            """Lines without their carriage returns, and the place of the first that is a party's name."""

            def line(x: Column, i: Column) -> Column:
                def without_end(body: Column) -> Column:
                    new = (
                        F.when(field["reference"], keep_format(key, body, field["salt"]))
                        .when(
                            body.startswith("/") & (F.length(body) > 1),
                            let(F.substr(body, F.lit(2)), lambda account: account_line(account, field["salt"])),
                        )
                        .when(body.rlike(BIC_LINE), swift_bic(key, body, field["salt"], row=known))
                        .when((i + 1) == field["party"], full_name(key, body, field["salt"]))
                        .otherwise(body)
                    )
                    return F.when(x.endswith("\r"), F.concat(new, F.lit("\r"))).otherwise(new)

                return let(F.regexp_replace(x, "\r$", ""), without_end)

            return F.array_join(F.transform(field["lines"], line), "\n")

        def fields(lines: Column) -> Column:
            bare = F.transform(lines, lambda x: F.regexp_replace(x, "\r$", ""))
            plain = F.transform(
                bare, lambda x: ~(x.startswith("/") & (F.length(x) > 1)) & ~x.rlike(BIC_LINE) & (F.trim(x) != "")
            )
            party = F.when(name.isin(*PARTY_TAGS), F.array_position(plain, F.lit(True))).otherwise(F.lit(0))
            return F.struct(
                lines.alias("lines"), party.alias("party"), name.isin(*REFERENCE_TAGS).alias("reference"), own.alias("salt")
            )

        return let(let(F.split(text, "\n", -1), fields), masked_lines)

    def text_block(body: Column) -> Column:
        pieces = F.split(body, r"(?m)(?=^:[0-9]{2}[A-Z]?:)", -1)

        def piece(x: Column) -> Column:
            def named(name: Column) -> Column:
                start = F.length(name) + 3
                return F.when(name == "", x).otherwise(
                    F.concat(F.substr(x, F.lit(1), start - 1), field_value(name, F.substr(x, start)))
                )

            return let(F.regexp_extract(x, "^:([0-9]{2}[A-Z]?):", 1), named)

        return F.array_join(F.transform(pieces, piece), "")

    begin = F.locate("{4:", value)
    end = F.locate("-}", value, 1)
    before = F.substr(value, F.lit(1), begin + 2)
    after_start = F.length(F.substring_index(value, "{4:", 1)) + 4
    rest = F.substr(value, after_start)
    body = F.substring_index(rest, "-}", 1)
    tail = F.substr(rest, F.length(body) + 1)
    header = replace_matches(before, r"\{1:[A-Z][0-9]{2}[A-Z0-9]{8}", head("1", 3))
    header = replace_matches(header, r"\{2:I[0-9]{3}[A-Z0-9]{8}", head("2", 4))
    is_message = value.contains("{1:") & (begin > 0) & (end > 0)
    return F.when(is_message, F.concat(header, text_block(body), tail)).otherwise(value)


# ---------------------------------------------------------------- dispatch

MASKS: dict[str, Callable] = {
    "FIRST_NAME": first_name, "LAST_NAME": last_name, "COMPANY": company, "FULL_NAME": full_name, "EMAIL": email,
    "PHONE": phone, "SSN": ssn, "CREDIT_CARD": credit_card, "DATE_SHIFT": date_shift, "DOB_AGE_BAND": dob_age_band,
    "AGE": age, "ADDRESS_STREET": address_street, "ADDRESS_US": address_us, "CITY_STATE_ZIP": city_state_zip,
    "CHARACTER_MAP": character_mapping, "FORMAT_PRESERVE": format_preserve, "TOKENIZE": tokenize,
    "SECURE_LOOKUP": secure_lookup, "HASH_LOV": hash_lov, "REDACT": redact, "REDACT_KEEP_LAST4": redact_keep_last4,
    "NUMERIC_NOISE": numeric_noise, "MIN_MAX": min_max, "BANK_ACCOUNT": bank_account, "IBAN": iban,
    "SWIFT_BIC": swift_bic, "ABA_ROUTING": aba_routing, "NATIONAL_ID": national_id, "IP_ADDRESS": ip_address,
    "MAC_ADDRESS": mac_address, "UUID": uuid, "BY_INDICATOR": by_indicator, "PARTIAL_MASK": partial_mask,
    "PHONE_SPLIT": phone_split, "SSN_SPLIT": ssn_split, "DATE_SPLIT": date_split, "SWIFT_MT": swift_mt,
}
ALWAYS_RUN = {"DIRECT_LOOKUP": direct_lookup, "HASH_LOOKUP": hash_lookup}
SCRIPTS: dict[str, Callable] = {}


def register_mask(name: str, build: Callable) -> None:
    """Add a user mask: ``build(value, param, row, key, salt) -> Column``; it may wrap a pandas UDF."""
    SCRIPTS[name.strip().lower()] = build


# Marks of multi-value text, highest level first (field, value, sub-value, text).
FIELD_MARK, VALUE_MARK, SUB_MARK, TEXT_MARK = "þ", "ý", "ü", "û"
MARKS = FIELD_MARK + VALUE_MARK + SUB_MARK + TEXT_MARK


def each_leaf(value: Column, change: Callable[[Column], Column]) -> Column:
    """Change every non-empty segment between marks; marks and empty segments stay."""
    pieces = F.regexp_extract_all(value, F.lit(f"[^{MARKS}]+|[{MARKS}]"), F.lit(0))
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike(f"^[{MARKS}]$"), p).otherwise(F.coalesce(change(p), F.lit("")))), ""
    )


def mask(
    name: str, value: Column, key: MaskKey, salt: Salt | None = None, p1: str | None = None, p2: str | None = None,
    row: Row | None = None, multi_value: bool = False,
) -> Column:
    """Masked string column. Null and empty values stay, except for the functions defined on them."""
    fn = name.strip().upper()
    text = value.cast("string")
    if salt is None:
        salt = SALTS.get(fn, fn.lower())
    if fn == "PASSTHROUGH":
        return value
    if fn == "NULLIFY":
        return F.lit(None).cast("string")
    if fn == "FIXED":
        return in_case(F.lit(p1), case_of(p2))
    if fn == "SEQUENCE":
        if row is None or row.index is None:
            raise ValueError("SEQUENCE needs a row index (see operators.mapping.with_sequence)")
        return F.concat(F.lit("ID-" if p1 is None else p1), row.index.cast("string"))
    if fn in ALWAYS_RUN:
        return ALWAYS_RUN[fn](key, text, salt, p1, p2, row)
    if fn == "SCRIPT":
        return SCRIPTS[(p1 or "").strip().lower()](text, p2, row, key, salt)
    if fn not in MASKS:
        raise ValueError(f"unknown masking function {name}")
    build = MASKS[fn]
    if multi_value:
        masked = each_leaf(text, lambda leaf: build(key, leaf, salt, p1, p2, row))
    else:
        masked = build(key, text, salt, p1, p2, row)
    return F.when(text.isNull() | (text == ""), text).otherwise(masked)
