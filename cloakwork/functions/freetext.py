"""Personal data in free text: ordered rules, each a pattern and the mask of what it finds. Whole texts, on the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cloakwork.functions.keyed import MaskKey, let, luhn_valid
from cloakwork.functions.masks import Row, mask
from cloakwork.functions.scanner import change_leaves, selects


@dataclass(frozen=True)
class TextRule:
    """The value is the whole match, what follows a lead pattern, or the first n characters of the match.

    ``needs`` is a cheap pattern that every text with a match must contain; other texts skip the rule.
    """

    name: str
    kind: str
    pattern: str
    function: str
    needs: str = ""
    lead: str | None = None
    head: int | None = None
    p1: str | None = None
    p2: str | None = None
    selector: str | None = None


# Default rules, in order.
NAME_LEAD = r"(?:(?:my\s+)?name\s*(?:is|[:=])\s*|(?:customer|client|patient)\s+)"
NAME_STOP = r"my\b|ssn\b|social\b|phone\b|email\b|card\b|account\b|dob\b|address\b"
NAME_VALUE = rf"[\p{{L}}][\p{{L}}'-]{{1,49}}(?:\s+(?!{NAME_STOP})[\p{{L}}][\p{{L}}'-]{{1,49}}){{0,3}}"
NAME_END = r"(?=\s*(?:[,;:]|\bmy\b|\b(?:ssn|social|phone|email|card|account|dob|address)\b|$))"
SSN_LABEL = r"(?:ssn|social\s+security(?:\s+number)?)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
DEFAULT_RULES = [
    TextRule("Contextual full name", "FULL_NAME", NAME_LEAD + NAME_VALUE + NAME_END, "FULL_NAME", "name|customer|client|patient", lead=NAME_LEAD),
    TextRule(
        "Compact SSN after label", "SSN", SSN_LABEL + r"\s*(?:is|[:=#-])?\s*\d{9}(?!\d)", "SSN", r"\d{9}",
        lead=SSN_LABEL + r"\s*(?:is|[:=#-])?\s*",
    ),
    TextRule("Compact SSN before label", "SSN", r"(?<!\d)\d{9}\s*(?:is\s+)?(?:my\s+)?" + SSN_LABEL, "SSN", r"\d{9}", head=9),
    TextRule("Email address", "EMAIL", r"(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9])", "EMAIL", "@"),
    TextRule("US Social Security number", "SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "SSN", r"\d-\d{2}-\d"),
    TextRule("Payment card", "CREDIT_CARD", r"(?<!\d)(?:\d[ -]?){12,19}(?!\d)", "CREDIT_CARD", r"(?:\d[ -]?){12}"),
    TextRule("IBAN", "IBAN", r"(?<![A-Z0-9])[A-Z]{2}\d{2}[A-Z0-9]{10,30}(?![A-Z0-9])", "IBAN", r"[A-Z]{2}\d{2}"),
    TextRule("IPv4 address", "IP_ADDRESS", rf"(?<!\d){OCTET}(?:\.{OCTET}){{3}}(?!\d)", "IP_ADDRESS", r"\d\.\d"),
    TextRule("MAC address", "MAC_ADDRESS", r"(?<![0-9A-F])(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}(?![0-9A-F])", "MAC_ADDRESS", "[0-9A-F]{2}[:-][0-9A-F]{2}[:-]"),
    TextRule(
        "Phone number", "PHONE", r"(?<!\w)(?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\w)", "PHONE", r"\d{3}\)?[ .-]?\d{4}"
    ),
]


# Types whose default pattern finds nothing but values of the right shape.
SHAPED = {"SSN", "CREDIT_CARD", "IP_ADDRESS", "MAC_ADDRESS", "PHONE"}


def masked_match(rule: TextRule, match: Column, key: MaskKey) -> Column:
    salt = f"unstructured.{rule.kind.lower()}"
    row = Row(shaped=rule in DEFAULT_RULES and rule.kind in SHAPED)

    def value_mask(value: Column) -> Column:
        return F.coalesce(mask(rule.function, value, key, salt, rule.p1, rule.p2, row), F.lit(""))

    if rule.lead:
        lead = F.regexp_extract(match, f"(?iu)^({rule.lead})", 1)
        return F.concat(lead, value_mask(F.substr(match, F.length(lead) + 1)))
    if rule.head:
        return F.concat(value_mask(F.substring(match, 1, rule.head)), F.substr(match, F.lit(rule.head + 1)))
    if rule.kind == "CREDIT_CARD":
        card = F.regexp_replace(match, "[ -]", "")
        return F.when(luhn_valid(card), value_mask(match)).otherwise(match)
    return value_mask(match)


def apply_rule(rule: TextRule, text: Column, key: MaskKey) -> tuple[Column, Column]:
    """Text after the rule, and how many values it changed."""
    pattern = f"(?iu){rule.pattern}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    new = F.transform(found, lambda m: masked_match(rule, m, key))
    out = F.array_join(
        F.zip_with(F.split(text, pattern, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), ""
    )
    counted = found
    if rule.kind == "CREDIT_CARD":
        counted = F.filter(found, lambda m: luhn_valid(F.regexp_replace(m, "[ -]", "")))
    return out, F.size(counted)


def mask_text(text: Column, key: MaskKey, rules: Sequence[TextRule] = DEFAULT_RULES, path: Column | None = None) -> Column:
    """Struct of the masked ``text`` and ``found``, the number of changed values per rule, in rule order.

    With the ``path`` of a leaf, rules run only where their selector names it.

    The rules run one after the other over the whole text as one fold, so the text is an ordinary lambda variable
    in each step and is never recomputed.
    """
    start = F.struct(text.alias("text"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, place: Column) -> Column:
        out = None
        for i, rule in enumerate(rules):
            new, count = apply_rule(rule, state["text"], key)
            result = F.struct(new.alias("text"), F.concat(state["found"], F.array(count)).alias("found"))
            skipped = F.struct(state["text"].alias("text"), F.concat(state["found"], F.array(F.lit(0))).alias("found"))
            wanted = state["text"].rlike(f"(?iu){rule.needs}")
            if path is not None and rule.selector:
                wanted = selects(rule.selector, path) & wanted
            result = F.when(wanted, result).otherwise(skipped)
            out = F.when(place == i, result) if out is None else out.when(place == i, result)
        return out.otherwise(state)

    steps = F.array(*[F.lit(i) for i in range(len(rules))])
    nothing = F.struct(text.alias("text"), F.array(*[F.lit(0) for _ in rules]).alias("found"))
    hints = "(?iu)" + "|".join(dict.fromkeys(rule.needs for rule in rules))
    return F.when(text.rlike(hints), F.aggregate(steps, start, step)).when(text.isNotNull(), nothing)


def masked_text(text: Column, key: MaskKey, rules: Sequence[TextRule] = DEFAULT_RULES) -> Column:
    return mask_text(text, key, rules)["text"]


def mask_leaves(value: Column, form: str, key: MaskKey, rules: Sequence[TextRule] = DEFAULT_RULES) -> Column:
    """A JSON, XML or HTML text whose leaves went through the rules that select them."""
    return change_leaves(value, form, lambda text, path: mask_text(text, key, rules, path)["text"])


def mask_cells(cells: DataFrame, key: MaskKey, rules: Sequence[TextRule] = DEFAULT_RULES) -> DataFrame:
    """Every text cell of a delimited file through the rules whose selector is part of its column's name."""
    out = []
    for f in cells.schema.fields:
        mine = [r for r in rules if (r.selector or "").strip().lower() in f.name.lower()]
        text = isinstance(f.dataType, StringType) and mine
        quoted = F.col("`" + f.name.replace("`", "``") + "`")
        out.append(masked_text(quoted, key, mine).alias(f.name) if text else quoted)
    return cells.select(*out)


def counts_by_kind(found: Column, rules: Sequence[TextRule] = DEFAULT_RULES) -> Column:
    """Map of personal-data type to the number of changed values."""
    kinds = list(dict.fromkeys(r.kind for r in rules))
    parts = []
    for kind in kinds:
        total = F.lit(0)
        for i, rule in enumerate(rules):
            if rule.kind == kind:
                total = total + found[i]
        parts += [F.lit(kind), total]
    return F.map_filter(F.create_map(*parts), lambda k, v: v > 0)


def text_changer(key: MaskKey, rules: Sequence[TextRule] = DEFAULT_RULES) -> Callable[[Column], Column]:
    """Function on text pieces, for pages and documents with markup."""
    return lambda piece: masked_text(piece, key, rules)
