"""SQL text for the checks: the same contracts written a second time, for a SQL engine with blobs and lambdas."""

from __future__ import annotations

from cloakwork.functions import wordlists as words
from cloakwork.functions.keyed import MaskKey


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(options: list[str]) -> str:
    return "[" + ", ".join(quoted(o) for o in options) + "]"


def digest(key: MaskKey, salt: str, value: str, salt_is_sql: bool = False) -> str:
    """HMAC hex of a text expression; ``salt`` is plain text or, if said so, a SQL text expression."""
    if salt_is_sql:
        head = f"unhex('{key.inner.hex()}') || encode({salt}) || unhex('1f')"
    else:
        head = f"unhex('{(key.inner + salt.encode() + bytes([0x1F])).hex()}')"
    inner = f"sha256({head} || encode({value}))"
    return f"sha256(unhex('{key.outer.hex()}') || unhex({inner}))"


def number_of(hexed: str) -> str:
    """Non-negative 63-bit number from hex text."""
    return f"(('0x' || substr({hexed}, 1, 16))::UBIGINT % 9223372036854775808::UBIGINT)::BIGINT"


def number(key: MaskKey, salt: str, value: str) -> str:
    return number_of(digest(key, salt, value))


def index(key: MaskKey, salt: str, value: str, size: int) -> str:
    return f"({number(key, salt, value)} % {size})"


def pick(key: MaskKey, salt: str, value: str, options: list[str]) -> str:
    return f"({listing(options)})[{index(key, salt, value, len(options))} + 1]"


def draw(hexed: str, place: int, bound: int) -> str:
    """Draw at a place of a digest, below a bound."""
    return f"(('0x' || substr({hexed}, {8 * place + 1}, 8))::UBIGINT::BIGINT % {bound})"


def draws(key: MaskKey, salt: str, value: str) -> str:
    return digest(key, f"{salt}#0", value)


def stream(key: MaskKey, salt: str, value: str) -> str:
    """Hex text with four digits per character of the value."""
    block = digest(key, f"{quoted(salt + '#')} || b::VARCHAR", value, salt_is_sql=True)
    return (
        f"array_to_string(list_transform(range(0, (greatest(length({value}), 1) - 1) // 16 + 1), "
        f"lambda b: {block}), '')"
    )


def stream_draw(hexed: str, place: str, bound: str | int) -> str:
    return f"(('0x' || substr({hexed}, ({place}) * 4 + 1, 4))::UBIGINT::BIGINT % {bound})"


def moved_letters(value: str, hexed: str) -> str:
    """Format-keeping change of the ASCII letters and digits of a value."""

    def move(base: int, size: int) -> str:
        return f"chr(({base} + (ascii(c) - {base} + 1 + {stream_draw(hexed, 'i - 1', size - 1)}) % {size})::INT)"

    return (
        f"array_to_string(list_transform(string_split({value}, ''), lambda c, i: CASE "
        f"WHEN c BETWEEN '0' AND '9' AND ascii(c) < 128 THEN {move(48, 10)} "
        f"WHEN ascii(c) BETWEEN 97 AND 122 THEN {move(97, 26)} "
        f"WHEN ascii(c) BETWEEN 65 AND 90 THEN {move(65, 26)} ELSE c END), '')"
    )


def keep_format(key: MaskKey, salt: str, value: str) -> str:
    return moved_letters(value, stream(key, salt + "|fpe", value))


def normal(value: str) -> str:
    return f"lower(trim({value}))"


def name_at(heads: list[str], tails: list[str], place: str, gap: str = "") -> str:
    n = len(heads)
    return f"(({listing(heads)})[({place}) % {n} + 1] || {quoted(gap)} || ({listing(tails)})[({place}) // {n} + 1])"


def first_name(key: MaskKey, salt: str, value: str) -> str:
    place = index(key, salt + "|first_names.txt", normal(value), words.FIRST_SIZE)
    return name_at(words.FIRST_HEADS, words.FIRST_TAILS, place)


def last_name(key: MaskKey, salt: str, value: str) -> str:
    place = index(key, salt + "|last_names.txt", normal(value), words.LAST_SIZE)
    return name_at(words.LAST_HEADS, words.LAST_TAILS, place)


def luhn_ok(digits: str) -> str:
    """True for a digit text with a right check digit."""
    terms = (
        f"list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 0 "
        f"THEN (c::INT * 2) // 10 + (c::INT * 2) % 10 ELSE c::INT END)"
    )
    return f"(list_sum({terms}) % 10 = 0)"
