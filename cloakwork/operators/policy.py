"""Masking policies on tables: rules, overrides, conditions, shared key salts, jobs over many tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions import masks, numbers
from cloakwork.functions.keyed import MaskKey
from cloakwork.functions.masks import PRIORITY, SALTS, Row
from cloakwork.operators.discovery import category
from cloakwork.operators.positions import with_sequence
from cloakwork.operators.subset import Edge, referenced_first
from cloakwork.session import small_side


@dataclass(frozen=True)
class Clause:
    """Test of a column; with a join the tested column sits in another table, found by key."""

    column: str
    operator: str = "EQ"
    value: str | None = None
    join_table: str | None = None
    source_key: str | None = None
    target_key: str | None = None


@dataclass(frozen=True)
class Rule:
    table: str
    column: str
    function: str
    salt: str | None = None
    p1: str | None = None
    p2: str | None = None
    clauses: tuple[Clause, ...] = ()
    logic: str = "ALL"
    condition: str | None = None
    multi_value: bool = False


@dataclass(frozen=True)
class Override:
    """USE_POLICY, LITERAL, NULL_OUT or SUPPRESS for one column."""

    table: str
    column: str
    action: str = "USE_POLICY"
    literal: object = None


@dataclass
class Policy:
    key: MaskKey
    rules: Sequence[Rule]
    overrides: Sequence[Override] = field(default_factory=list)
    shared_salts: Mapping[tuple[str, str], str] = field(default_factory=dict)
    shared_limits: Mapping[tuple[str, str], tuple[int, int] | None] = field(default_factory=dict)

    def number_limit(self, rule: Rule, kind: T.DataType) -> tuple[int, int] | None:
        """Largest magnitudes of a number that keeps its digits; None where the rule works on text."""
        plain = rule.function.upper() in ("FORMAT_PRESERVE", "CHARACTER_MAP") and not (rule.p1 or rule.p2 or rule.multi_value)
        own = numbers.highest(kind) if plain else None
        if own is None or max(own) >= 10**numbers.DIGITS:
            return None
        return self.shared_limits.get((rule.table.lower(), rule.column.lower()), own)

    def salt(self, rule: Rule) -> str:
        shared = self.shared_salts.get((rule.table.lower(), rule.column.lower()))
        if rule.salt and rule.salt.strip():
            return rule.salt.strip()
        return shared or SALTS.get(rule.function.upper()) or f"{rule.table}.{rule.column}".lower()


def key_salts(edges: Sequence[Edge]) -> dict[tuple[str, str], str]:
    """One salt for all columns that a chain of foreign keys links: ``ri:<least name>``."""
    groups: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for e in edges:
        a, b = (e.child.lower(), e.child_column.lower()), (e.parent.lower(), e.parent_column.lower())
        merged = groups.get(a, {a}) | groups.get(b, {b})
        for member in merged:
            groups[member] = merged
    return {m: "ri:" + min(".".join(x) for x in members) for m, members in groups.items()}


def key_limits(edges: Sequence[Edge], tables: Mapping[str, DataFrame]) -> dict[tuple[str, str], tuple[int, int] | None]:
    """The narrowest range of the number columns that share a salt; None where one of them is text or has another scale."""
    kinds = {(t.lower(), f.name.lower()): f.dataType for t, df in tables.items() for f in df.schema.fields}
    groups: dict[str, list[tuple[str, str]]] = {}
    for member, salt in key_salts(edges).items():
        if member in kinds:
            groups.setdefault(salt, []).append(member)
    out = {}
    for members in groups.values():
        limits = [numbers.highest(kinds[m]) for m in members]
        scales = {getattr(kinds[m], "scale", 0) for m in members}
        common = None if None in limits or len(scales) > 1 else (min(x for x, _ in limits), min(x for _, x in limits))
        out.update(dict.fromkeys(members, common))
    return out


# ---------------------------------------------------------------- conditions

def compare(value: Column, operator: str, expected: str | None) -> Column:
    """Case-insensitive clause; null counts as true only for NE, NOT_IN and IS_NULL."""
    name = (operator or "EQ").strip().upper()
    text = value.cast("string")
    if name == "IS_NULL":
        return text.isNull() | (text == "")
    if name == "IS_NOT_NULL":
        return text.isNotNull() & (text != "")
    v, e = F.lower(F.trim(text)), (expected or "").strip().lower()
    options = [x.strip() for x in e.split(",") if x.strip()]
    if name in ("GT", "LT", "GTE", "LTE"):
        number, limit = F.trim(text).try_cast("double"), F.lit(e).try_cast("double")
        tests = {
            "GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GTE": lambda a, b: a >= b, "LTE": lambda a, b: a <= b,
        }
        both = number.isNotNull() & limit.isNotNull()
        result = F.when(both, tests[name](number, limit)).otherwise(tests[name](v, F.lit(e)))
    else:
        result = {
            "NE": lambda: v != e, "CONTAINS": lambda: v.contains(e), "STARTS_WITH": lambda: v.startswith(e),
            "IN": lambda: v.isin(*options) if options else F.lit(False),
            "NOT_IN": lambda: ~v.isin(*options) if options else F.lit(True),
        }.get(name, lambda: v == e)()
    return F.coalesce(result, F.lit(name in ("NE", "NOT_IN")))


def clause_column(clause: Clause, row: Mapping[str, Column]) -> Column:
    if clause.join_table:
        return F.col(joined_name(clause))
    return row[clause.column.lower()]


def joined_name(clause: Clause) -> str:
    return f"_cond_{clause.join_table}_{clause.target_key}_{clause.column}".lower()


def with_joined_columns(df: DataFrame, rules: Sequence[Rule], others: Mapping[str, DataFrame]) -> DataFrame:
    """Adds the columns that joined clauses test; the other table is made unique per key first."""
    added = set()
    for clause in (c for r in rules for c in r.clauses if c.join_table):
        name = joined_name(clause)
        if name in added:
            continue
        added.add(name)
        other = others[clause.join_table]
        side = other.groupBy(F.lower(F.trim(F.col(clause.target_key).cast("string"))).alias("_cond_key")).agg(
            F.max(F.col(clause.column).cast("string")).alias(name)
        )
        own = F.lower(F.trim(F.col(clause.source_key).cast("string")))
        df = df.join(side, own == F.col("_cond_key"), "left").drop("_cond_key")
    return df


def rule_condition(rule: Rule, row: Mapping[str, Column]) -> Column | None:
    if rule.condition:
        return F.coalesce(F.expr(rule.condition), F.lit(False))
    if not rule.clauses:
        return None
    tests = [compare(clause_column(c, row), c.operator, c.value) for c in rule.clauses]
    out = tests[0]
    for test in tests[1:]:
        out = (out | test) if rule.logic.upper() == "ANY" else (out & test)
    return out


# ---------------------------------------------------------------- one table

# Functions whose results are words or tokens, whatever they are given.
TEXT_RESULTS = {
    "TOKENIZE", "FIRST_NAME", "LAST_NAME", "FULL_NAME", "COMPANY", "EMAIL", "ADDRESS_STREET", "ADDRESS_US", "CITY_STATE_ZIP",
    "UUID", "IBAN", "SWIFT_BIC", "SWIFT_MT", "IP_ADDRESS", "MAC_ADDRESS", "NATIONAL_ID",
}


def check_fit(rule: Rule, kind: T.DataType) -> None:
    """Refuse, before anything runs, a mask whose results the column's type cannot hold."""
    if not isinstance(kind, T.StringType) and rule.function.upper() in TEXT_RESULTS:
        raise ValueError(f"{rule.table}.{rule.column}: {rule.function} makes text, the column is {kind.simpleString()}")


def back_to_type(value: Column, kind: T.DataType, name: str = "value") -> Column:
    """Masked text in the column's type; a value that does not fit fails the job instead of becoming null."""
    if isinstance(kind, T.StringType):
        return value
    typed = value.try_cast(kind)
    lost = F.raise_error(F.concat(F.lit(f"masked {name} does not fit {kind.simpleString()}: "), value.cast("string"))).cast(kind)
    return F.when(value.isNotNull() & typed.isNull(), lost).otherwise(typed)


def source_text(value: Column, kind: T.DataType) -> Column:
    """Text form that masks work on: dates and timestamps in ISO form, numbers without exponent."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = value.cast("string")
        return F.when(plain.contains("E"), value.cast("decimal(38,6)").cast("string")).otherwise(plain)
    return value.cast("string")


def apply_policy(
    df: DataFrame, table: str, policy: Policy, others: Mapping[str, DataFrame] | None = None,
    sequence_order: Sequence[str] | None = None,
) -> DataFrame:
    """Masked table. Names are masked first and composed values last, so that these can use masked siblings."""
    rules = [r for r in policy.rules if r.table.lower() == table.lower()]
    overrides = {o.column.lower(): o for o in policy.overrides if o.table.lower() == table.lower()}
    fixed = {c for c, o in overrides.items() if o.action.upper() != "USE_POLICY"}
    active = [r for r in rules if r.column.lower() not in fixed]
    columns = df.columns
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    for rule in active:
        if rule.column.lower() in kinds:
            check_fit(rule, kinds[rule.column.lower()])
    if any(r.function.upper() == "SEQUENCE" for r in active):
        df = with_sequence(df, sequence_order or columns, "_row_index", 0)
    df = with_joined_columns(df, active, others or {})
    text = {c.lower(): source_text(F.col(c), kinds[c.lower()]) for c in columns}
    shift_rules = [r for r in active if r.function.upper() == "DATE_SHIFT"]
    span = masks.shared_range([r.p1 for r in shift_rules])
    shift = masks.row_shift(policy.key, text, *span) if span else None
    index = F.col("_row_index") if "_row_index" in df.columns else None
    done: dict[str, str] = {}
    siblings: dict[str, Column] = {}
    for stage in (0, 1, 2):
        batch = [r for r in active if PRIORITY.get(r.function.upper(), 1) == stage]
        if not batch:
            continue
        new = {}
        for r in batch:
            source = r.column.lower()
            row = Row(text, siblings, shift, index)
            original = text[source]
            limit = policy.number_limit(r, kinds[source])
            if limit is not None:
                masked, original = numbers.keep_digits(policy.key, policy.salt(r), F.col(r.column), kinds[source], limit), F.col(r.column)
            elif r.function.upper() == "DATE_SHIFT" and not (r.p2 or r.multi_value) and category(kinds[source]) == "DATE":
                masked, original = masks.shifted(policy.key, F.col(r.column), text[source], policy.salt(r), r.p1, row), F.col(r.column)
            else:
                masked = masks.mask(r.function, text[source], policy.key, policy.salt(r), r.p1, r.p2, row, r.multi_value)
            test = rule_condition(r, {c.lower(): F.col(c) for c in columns})
            if test is not None:
                masked = F.when(test, masked).otherwise(original)
            new[f"_masked_{source}"] = masked
            done[source] = f"_masked_{source}"
        df = df.withColumns(new)
        for r in batch:
            alias = {"FIRST_NAME": "first_name", "LAST_NAME": "last_name"}.get(r.function.upper())
            if alias:
                siblings[alias] = F.col(f"_masked_{r.column.lower()}")
    out = []
    for c in columns:
        o = overrides.get(c.lower())
        action = o.action.upper() if o else "USE_POLICY"
        if action == "SUPPRESS":
            continue
        if action == "LITERAL":
            out.append(F.lit(o.literal).cast(kinds[c.lower()]).alias(c))
        elif action == "NULL_OUT":
            out.append(F.lit(None).cast(kinds[c.lower()]).alias(c))
        elif c.lower() in done:
            out.append(back_to_type(F.col(done[c.lower()]), kinds[c.lower()], f"{table}.{c}").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def mask_tables(
    tables: Mapping[str, DataFrame], policy: Policy, edges: Sequence[Edge]
) -> dict[str, DataFrame]:
    """Many tables in load order; columns linked by foreign keys share one salt, so masked keys still join."""
    limits = {**key_limits(edges, tables), **policy.shared_limits}
    linked = Policy(policy.key, policy.rules, policy.overrides, {**key_salts(edges), **policy.shared_salts}, limits)
    return {t: apply_policy(tables[t], t, linked, tables) for t in referenced_first(list(tables), edges)}


def mask_sources(
    readers: Mapping[str, tuple], default: Policy, edges: Sequence[Edge] = ()
) -> dict[str, DataFrame]:
    """Each table from its own reader ``(read, policy or None)``; the own policy wins over the default."""
    frames = {table: read() for table, (read, _) in readers.items()}
    salts, limits = key_salts(edges), key_limits(edges, frames)
    out = {}
    for table, (_, own) in readers.items():
        chosen = own or default
        shared = Policy(chosen.key, chosen.rules, chosen.overrides, {**salts, **chosen.shared_salts}, {**limits, **chosen.shared_limits})
        out[table] = apply_policy(frames[table], table, shared)
    return out


def before_and_after(source: DataFrame, target: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """First rows of a finished job, source beside target."""
    first = source.orderBy(*key).limit(rows)
    right = target.select(
        *[F.col(k).alias(f"_t_{k}") for k in key], *[F.col(c).alias(f"{c}_after") for c in target.columns if c not in key]
    )
    match = [F.col(k) == F.col(f"_t_{k}") for k in key]
    return first.join(right, match, "left").drop(*[f"_t_{k}" for k in key])


def value_list(df: DataFrame, column: str, cap: int | None = None, weights: bool = True) -> DataFrame:
    """Distinct non-null values of a column with their counts, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("entry")).agg(
        F.count(F.lit(1)).alias("weight")
    )
    out = counted.orderBy(F.col("weight").desc(), F.col("entry"))
    out = out.limit(cap) if cap else out
    return out if weights else out.select("entry")


def lookup_by_table(df: DataFrame, column: str, table: DataFrame, source: str, replacement: str, missing: str = "PRESERVE") -> DataFrame:
    """DIRECT_LOOKUP with a value table too long for a literal: a left join, broadcast only when small."""
    pairs = table.select(F.col(source).cast("string").alias("_from"), F.col(replacement).alias("_to"), F.lit(True).alias("_hit"))
    joined = df.join(small_side(pairs), F.col(column).cast("string") == F.col("_from"), "left")
    action = missing.upper()
    other = {
        "PRESERVE": F.col(column).cast("string"), "NULL": F.lit(None).cast("string"),
        "REDACT": masks.keep_ends(F.col(column).cast("string"), "*", 0, 0),
        "ERROR": F.raise_error(F.lit("lookup found no matching key")).cast("string"),
    }[action]
    value = F.when(F.col("_hit"), F.col("_to")).when(F.col(column).isNull(), F.lit(None)).otherwise(other)
    return joined.withColumn(column, value).drop("_from", "_to", "_hit")


def pick_by_table(df: DataFrame, column: str, key: MaskKey, salt: str, table: DataFrame, entry: str) -> DataFrame:
    """Keyed pick from a long value list kept as a table: index join instead of a literal array."""
    numbered = with_sequence(table.select(entry), [entry], "_place", 0)
    size = numbered.count()
    place = key.index(salt, masks.normalise(F.col(column).cast("string")), size)
    joined = df.withColumn("_pick", place).join(small_side(numbered), F.col("_pick") == F.col("_place"), "left")
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), F.col(entry))).drop("_pick", "_place", entry)
