"""Checks on masked data: leaks, formats, key consistency, variety, erasure, audit chain, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.keyed import iban_valid, luhn_valid, weighted_digit_sum
from cloakwork.functions.masks import UK_LETTERS, mode_of
from cloakwork.functions.text import only_digits
from cloakwork.operators.discovery import VALUE_HINTS
from cloakwork.operators.policy import Rule
from cloakwork.operators.positions import with_sequence
from cloakwork.session import small_side

FINDING = (
    "severity string, check_name string, table_name string, column_name string, pii_type string, "
    "affected_rows bigint, detail string, evidence string"
)


def finding(severity: Column | str, check: str, table: str, column: str | Column, pii: str | None, rows: Column, detail: Column | str, evidence: Column | None = None) -> list[Column]:
    """Columns of one finding row."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        as_column(severity).cast("string").alias("severity"), F.lit(check).alias("check_name"), F.lit(table).alias("table_name"),
        as_column(column).cast("string").alias("column_name"), F.lit(pii).cast("string").alias("pii_type"),
        rows.cast("bigint").alias("affected_rows"), as_column(detail).cast("string").alias("detail"),
        (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence"),
    ]


def leaked_rows(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Masked rows whose value also occurs among the source values."""
    known = source.select(F.col(column).cast("string").alias("_value")).where("_value IS NOT NULL").distinct()
    return target.join(known, F.col(column).cast("string") == F.col("_value"), "left_semi")


def leak_check(source: DataFrame, target: DataFrame, table: str, column: str) -> DataFrame:
    count = F.count(F.lit(1))
    return leaked_rows(source, target, column).agg(
        *finding(
            F.when(count > 0, "FAIL").otherwise("PASS"), "LEAK", table, column, None, count,
            F.concat(count.cast("string"), F.lit(" value(s) of the target still stand in the source")),
        )
    )


def format_ok(function: str, value: Column, p1: str | None = None, p2: str | None = None) -> Column:
    """Contract of a masking function's output; functions without one always hold."""
    name, v = function.upper(), value.cast("string")
    compact = F.upper(F.regexp_replace(v, r"[^A-Za-z0-9]", ""))
    if name == "EMAIL":
        return v.rlike(VALUE_HINTS["EMAIL"])
    if name == "SSN":
        shapes = {
            "KEEP_LAST4": r"^(\*{3}-\*{2}-\d{4}|\*{5}\d{4})$", "REDACT": r"^(\*{3}-\*{2}-\*{4}|\*{9})$",
        }
        return v.rlike(shapes.get(mode_of(p1, ""), r"^(\d{3}-\d{2}-\d{4}|\d{9})$"))
    if name == "CREDIT_CARD":
        return luhn_valid(F.regexp_replace(v, "[ -]", ""))
    if name in ("DOB_AGE_BAND", "DATE_SHIFT"):
        return v.rlike(r"^(\d{4}-\d{2}-\d{2}.*|\d{2}[/-]\d{2}[/-]\d{4})$")
    if name == "IBAN":
        return iban_valid(F.regexp_replace(v, r"\s", "")) & (F.length(F.regexp_replace(v, r"\s", "")) >= 15)
    if name == "SWIFT_BIC":
        return F.regexp_replace(v, r"\s", "").rlike(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")
    if name == "ABA_ROUTING":
        return routing_valid(v)
    if name == "NATIONAL_ID":
        country = mode_of(p1, "GENERIC")
        if country == "US":
            return v.rlike(r"^(\d{3}-\d{2}-\d{4}|\d{9})$")
        if country == "CA":
            return compact.rlike(r"^\d{9}$") & luhn_valid(F.lpad(compact, 12, "0"))
        if country == "UK":
            return compact.rlike(rf"^[{''.join(UK_LETTERS)}]{{2}}\d{{6}}[A-D]$")
        return compact != ""
    if name == "IP_ADDRESS":
        octet = r"(25[0-5]|2[0-4]\d|1\d\d|0*\d{1,2})"
        return F.trim(v).rlike(rf"^{octet}(\.{octet}){{3}}$") | F.trim(v).rlike(r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$")
    if name == "MAC_ADDRESS":
        return v.rlike(r"^(?i)([0-9a-f]{2}[:-]){5}[0-9a-f]{2}$")
    if name == "UUID":
        return v.rlike(r"^(?i)\{?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$")
    if name == "NUMERIC_NOISE":
        return F.trim(v).try_cast("decimal(38,10)").isNotNull()
    if name == "MIN_MAX":
        number = F.trim(v).try_cast("decimal(28,8)")
        return F.coalesce(number.between(F.lit(p1).cast("decimal(28,8)"), F.lit(p2).cast("decimal(28,8)")), F.lit(False))
    if name == "TOKENIZE":
        prefix = "TKN_" if p1 is None else "" if p1.upper() == "NONE" else p1
        length = max(12, min(64, int(p2) if p2 else 32))
        return v.startswith(prefix) & F.substr(v, F.lit(len(prefix) + 1)).rlike(rf"^(?i)[0-9a-f]{{{length}}}$")
    return F.lit(True)


def format_checks(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break the contract of their rule, all rules of a table in one pass."""
    mine = [r for r in rules if r.table.lower() == table.lower()]
    counts = df.agg(
        *[
            F.count_if(F.col(r.column).isNotNull() & ~F.coalesce(format_ok(r.function, F.col(r.column), r.p1, r.p2), F.lit(False))).alias(f"bad_{i}")
            for i, r in enumerate(mine)
        ]
    )
    rows = [
        F.struct(
            *finding(
                F.when(F.col(f"bad_{i}") > 0, "FAIL").otherwise("PASS"), "FORMAT", table, r.column, None, F.col(f"bad_{i}"),
                F.concat(F.col(f"bad_{i}").cast("string"), F.lit(f" value(s) are not in the form that {r.function} promises")),
            )
        )
        for i, r in enumerate(mine)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def deliverable_domain(df: DataFrame, table: str, column: str) -> DataFrame:
    count = F.count_if(F.col(column).contains("@") & ~F.col(column).endswith(".test"))
    return df.agg(
        *finding(
            F.when(count > 0, "WARN").otherwise("PASS"), "DOMAIN", table, column, "EMAIL", count,
            F.concat(count.cast("string"), F.lit(" e-mail(s) whose domain may receive mail")),
        )
    )


def key_witness(pairs: Sequence[tuple[str, DataFrame, DataFrame, Sequence[str], str]]) -> DataFrame:
    """Source values that mask to more than one value across tables: ``(function, source, target, key, column)``."""
    parts = []
    for function, source, target, key, column in pairs:
        left = source.select(*key, F.col(column).cast("string").alias("source_value"))
        right = target.select(*key, F.col(column).cast("string").alias("masked_value"))
        parts.append(left.join(right, list(key)).select(F.lit(function).alias("function"), "source_value", "masked_value"))
    every = reduce(DataFrame.unionByName, parts).where("source_value IS NOT NULL AND masked_value IS NOT NULL").distinct()
    return every.groupBy("function", "source_value").agg(
        F.count(F.lit(1)).alias("masks"), F.min("masked_value").alias("one"), F.max("masked_value").alias("other")
    ).where("masks > 1")


SEVERITY_ORDER = ["PASS", "INFO", "WARN", "FAIL"]


def roll_up(findings: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL over all findings, with counts."""
    fails, warns = F.count_if(F.col("severity") == "FAIL"), F.count_if(F.col("severity") == "WARN")
    return findings.agg(
        F.when(fails > 0, "FAIL").when(warns > 0, "WARN").otherwise("PASS").alias("result"), fails.alias("fails"), warns.alias("warns"),
        F.count(F.lit(1)).alias("findings"),
    )


def uncovered(found: DataFrame, rules: Sequence[Rule], confirmed: float = 0.6) -> DataFrame:
    """Personal-data columns in the data that no rule masks: confirmed = FAIL, only suggested = WARN."""
    spark = found.sparkSession
    covered = spark.createDataFrame(
        [(r.table.lower(), r.column.lower()) for r in rules] or [("", "")], "_t string, _c string"
    ).distinct()
    open_columns = found.join(
        F.broadcast(covered), (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c")), "left_anti"
    )
    return open_columns.select(
        F.when(F.col("confidence") >= confirmed, "FAIL").otherwise("WARN").alias("severity"), F.lit("UNCOVERED").alias("check_name"),
        "table_name", "column_name", "pii_type", F.col("n_rows").alias("affected_rows"),
    )


# ---------------------------------------------------------------- leak by hash

HASH_CONTEXT = b"compliance/v1\0"


def normal_form(value: Column) -> Column:
    """Trimmed, upper case, without separators that differ between systems; null when nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.trim(value.cast("string")), r"[\s\-()./]", "")), F.lit(""))


def salted_hash(value: Column, secret: str) -> Column:
    head = HASH_CONTEXT + secret.encode("utf-8") + b"\0"
    return F.sha2(F.concat(F.lit(bytearray(head)), normal_form(value).cast("binary")), 256)


def hash_leaks(source: DataFrame, source_columns: Sequence[str], target: DataFrame, target_columns: Sequence[str], secret: str) -> DataFrame:
    """Target values found among the source hashes: rows per target column and a short witness."""
    def hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), salted_hash(F.col(c), secret).alias("hash")) for c in columns])
        return df.select(F.explode(cells).alias("x")).select("x.*").where("hash IS NOT NULL")

    counted = hashes(target, target_columns).groupBy("column_name", "hash").agg(F.count(F.lit(1)).alias("rows"))
    known = hashes(source, source_columns).select("hash").distinct()
    return counted.join(known, "hash", "left_semi").groupBy("column_name").agg(
        F.sum("rows").alias("affected_rows"), F.count(F.lit(1)).alias("leaked_values"), F.substring(F.min("hash"), 1, 16).alias("witness")
    )


# ---------------------------------------------------------------- real-world validity

# Top-level names and domains reserved for tests.
SAFE_TLDS = ["test", "example", "invalid", "localhost"]
SAFE_DOMAINS = ["example.com", "example.org", "example.net"]


def one_digit_only(digits: Column) -> Column:
    return digits.rlike(r"^(\d)\1*$")


def routing_valid(value: Column) -> Column:
    digits = only_digits(value)
    good = weighted_digit_sum(digits, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0
    return F.coalesce(F.when(F.length(digits) == 9, good).otherwise(F.lit(False)), F.lit(False))


def looks_real(kind: str, value: Column) -> Column:
    """True for a value that could exist in the world: issuable, deliverable, assignable or with a right check digit."""
    digits = only_digits(value)
    name = kind.upper()
    if name in ("SSN", "NATIONAL_ID", "TAX_ID"):
        area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
        ok = ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")
        out = (F.length(digits) == 9) & ok & ~one_digit_only(digits)
    elif name == "CREDIT_CARD":
        out = F.length(digits).between(13, 19) & ~one_digit_only(digits) & luhn_valid(digits)
    elif name in ("IBAN", "BANK_ACCOUNT"):
        out = iban_valid(value)
    elif name == "EMAIL":
        clean = F.lower(F.trim(value))
        domain = F.substr(clean, F.locate("@", clean) + 1)
        safe = domain.isin(*SAFE_DOMAINS) | F.element_at(F.split(domain, r"\."), -1).isin(*SAFE_TLDS)
        out = clean.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & ~safe
    elif name in ("PHONE", "FAX"):
        body = F.regexp_extract(digits, r"^1?([2-9]\d{2}[2-9]\d{6})$", 1)
        out = (body != "") & (F.substring(body, 1, 3) != "555") & (F.substring(body, 4, 3) != "555")
    elif name == "ROUTING":
        out = (F.length(digits) == 9) & ~one_digit_only(digits) & routing_valid(digits)
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def validity_leaks(df: DataFrame, table: str, kinds: Mapping[str, str]) -> DataFrame:
    """Columns (``column -> type``) that still hold real-looking values; one pass."""
    counts = df.agg(*[F.count_if(looks_real(k, F.col(c).cast("string"))).alias(f"real_{i}") for i, (c, k) in enumerate(kinds.items())])
    rows = [
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(k).alias("pii_type"), F.col(f"real_{i}").alias("real_rows"))
        for i, (c, k) in enumerate(kinds.items())
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- variety and keys

# Limits of the cardinality check.
COLLAPSE_ROWS, COLLAPSE_FAIL, COLLAPSE_WARN = 50, 0.10, 0.50


def cardinality(counts: DataFrame) -> DataFrame:
    """Collapsed columns from (column, value, rows) counts: constant or < 10 % distinct = FAIL, < 50 % = WARN."""
    per = counts.where("value IS NOT NULL").groupBy("column_name").agg(
        F.sum("rows").alias("total"), F.count(F.lit(1)).alias("distinct_values")
    )
    ratio = F.col("distinct_values") / F.col("total")
    severity = (
        F.when(F.col("total") < COLLAPSE_ROWS, F.lit(None)).when(F.col("distinct_values") <= 1, "FAIL")
        .when(ratio < COLLAPSE_FAIL, "FAIL").when(ratio < COLLAPSE_WARN, "WARN")
    )
    return per.select("column_name", severity.alias("severity"), "total", "distinct_values", F.round(ratio, 4).alias("ratio")).where(
        "severity IS NOT NULL"
    )


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Total rows, distinct keys and surplus rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("total"), F.count(F.lit(1)).alias("distinct_keys"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates")
    )


def clash_report(source: DataFrame, target: DataFrame, identity: Sequence[str], column: str) -> DataFrame:
    """Rows that share a masked key although their source keys differ: original, masked and how many rows clash.

    Rows are first counted by (masked, original) pair, so a mask that collapses to one value meets one row per original.
    """
    pairs = source.select(*identity, F.col(column).alias("original")).join(
        target.select(*identity, F.col(column).alias("masked")), list(identity)
    )
    counted = pairs.groupBy("masked", "original").agg(F.count(F.lit(1)).alias("n"))
    clashing = counted.groupBy("masked").agg(F.count("original").alias("originals"), F.sum("n").alias("rows")).where("originals > 1")
    return pairs.join(clashing, "masked")


# ---------------------------------------------------------------- erasure

def erasure_search(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], subject: str) -> DataFrame:
    """Rows per column that hold a subject's identifier, raw or in normal form; one pass per table."""
    raw = subject.strip()
    folded = "".join(ch for ch in raw if ch not in " -()./\t\n").upper()
    parts = []
    for table, (df, columns) in tables.items():
        hit = lambda c: (F.trim(F.col(c).cast("string")) == raw) | (normal_form(F.col(c)) == folded)
        counts = df.agg(*[F.count_if(F.coalesce(hit(c), F.lit(False))).alias(f"n{i}") for i, c in enumerate(columns)])
        rows = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("affected_rows")) for i, c in enumerate(columns)]
        parts.append(counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts).where("affected_rows > 0")


def reversible_rows(lookup: DataFrame, source_column: str, subjects: DataFrame, subject_column: str) -> DataFrame:
    """Stored look-up rows that could turn a mask back into one of the subjects."""
    wanted = subjects.select(normal_form(F.col(subject_column)).alias("_n")).where("_n IS NOT NULL").distinct()
    return lookup.join(wanted, normal_form(F.col(source_column)) == F.col("_n"), "left_semi")


# ---------------------------------------------------------------- waivers and posture

def apply_waivers(findings: DataFrame, waivers: DataFrame, today) -> DataFrame:
    """Approved, unexpired exceptions turn FAIL into WARN where their scope covers the finding."""
    active = waivers.where((F.col("status") == "APPROVED") & (F.col("expires_on") >= F.lit(today))).select(
        F.lower(F.trim("scope")).alias("_scope"), F.lower("pii_type").alias("_pii"), F.col("waiver_id").alias("_waiver")
    )
    table, column = F.lower("table_name"), F.lower(F.coalesce("column_name", F.lit("")))
    covered = F.array_compact(
        F.array(F.when(column != "", F.concat_ws(".", table, column)), table, F.when(column != "", F.lit(None).cast("string")))
    )
    numbered = findings.withColumn("_scopes", covered)
    matched = (
        numbered.where("severity = 'FAIL'").withColumn("_scope", F.explode("_scopes"))
        .join(small_side(active), "_scope").where(F.col("_pii").isNull() | (F.col("_pii") == F.lower("pii_type")))
        .groupBy("table_name", "column_name", "check_name").agg(F.min("_waiver").alias("waiver_id"))
        .withColumnsRenamed({"table_name": "_t", "column_name": "_c", "check_name": "_k"})
    )
    same = F.col("table_name").eqNullSafe(F.col("_t")) & F.col("column_name").eqNullSafe(F.col("_c")) & (F.col("check_name") == F.col("_k"))
    return (
        findings.join(matched, same, "left")
        .withColumn("severity", F.when((F.col("severity") == "FAIL") & F.col("waiver_id").isNotNull(), "WARN").otherwise(F.col("severity")))
        .drop("_t", "_c", "_k")
    )


def posture(findings: DataFrame, by: Sequence[str] = ("check_name",)) -> DataFrame:
    """Findings by kind with counts per severity."""
    return findings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("FAIL", "WARN", "PASS")],
        F.sum("affected_rows").alias("affected_rows"),
    )


# ---------------------------------------------------------------- audit chain

def event_hash(previous: Column, fields: Sequence[Column]) -> Column:
    """Base64 SHA-256 over the previous hash and the event's fields."""
    text = F.concat_ws("|", F.coalesce(previous, F.lit("")), *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.base64(F.unhex(F.sha2(text.cast("binary"), 256)))


def verify_chain(events: DataFrame, seq: str, fields: Sequence[str], anchor: str | None = None) -> DataFrame:
    """Breaks of a hash chain: content that does not match its hash, or a link that does not match the event before.

    ``anchor`` is a condition for events that start a new segment (their previous hash is empty). The order comes
    from the sequence number, the neighbour from an equi-join on the position.
    """
    placed = with_sequence(events, [seq], "_pos")
    before = placed.select((F.col("_pos") + 1).alias("_pos"), F.col("hash").alias("_expected"))
    joined = placed.join(before, "_pos", "left")
    own = event_hash(F.col("prev_hash"), [F.col(c) for c in fields])
    starts = F.coalesce(F.expr(anchor), F.lit(False)) if anchor else F.lit(False)
    content = F.col("hash") != own
    first = F.col("_expected").isNull() | starts
    link = F.when(starts, F.coalesce(F.col("prev_hash"), F.lit("")) != "").when(first, F.lit(False)).otherwise(
        ~F.col("prev_hash").eqNullSafe(F.col("_expected"))
    )
    reason = F.when(content, "CONTENT_MISMATCH").when(link, "LINK_BREAK")
    return joined.select(F.col(seq).alias("seq"), reason.alias("reason")).where("reason IS NOT NULL")


# ---------------------------------------------------------------- reconciliation

def reconcile(source: DataFrame, target: DataFrame, key: str, amounts: Sequence[str]) -> DataFrame:
    """Row count, key digest and exact sums of two sides, with their differences."""
    def side(df: DataFrame) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(F.col(key).cast("string")).cast("decimal(38,0)")).alias("keys"),
            *[F.sum(F.col(a).cast("decimal(18,2)")).alias(a) for a in amounts],
        ).withColumn("_one", F.lit(1))

    a, b = side(source).alias("a"), side(target).alias("b")
    out = [F.col("a.rows").alias("source_rows"), F.col("b.rows").alias("target_rows"), F.col("a.keys").eqNullSafe(F.col("b.keys")).alias("same_keys")]
    out += [(F.col(f"a.{x}") - F.col(f"b.{x}")).cast("double").alias(f"{x}_difference") for x in amounts]
    return a.join(b, F.col("a._one") == F.col("b._one")).select(*out)


def witness(value: str, secret: str) -> str:
    """Short salted digest of one value, as shown in a finding."""
    folded = "".join(ch for ch in value.strip() if ch not in " -()./\t\n").upper()
    return hashlib.sha256(HASH_CONTEXT + secret.encode() + b"\0" + folded.encode()).hexdigest()[:16]
