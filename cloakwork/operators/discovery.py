"""Personal-data discovery and column profiles: one scan per table, every column scored in one aggregate."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.keyed import iban_valid, luhn_valid
from cloakwork.functions.masks import MARKS
from cloakwork.functions.scanner import leaves
from cloakwork.operators.positions import top_in_group

# IBAN countries, column-name patterns, value patterns and suggested masks, in order of precedence.
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT "
    "JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA "
    "VA VG XK"
).split()
NAME_HINTS = {
    "EMAIL": r"(^|_)(e?mail)(_|$)|email_address",
    "SSN": r"(^|_)(ssn|social_sec|social_security)(_|$)?",
    "CREDIT_CARD": r"(card_num|card_no|cc_num|ccn|credit_card|pan)(_|$)?",
    "FIRST_NAME": r"(^|_)(first_?name|fname|given_?name)(_|$)?",
    "LAST_NAME": r"(^|_)(last_?name|lname|sur_?name|family_?name)(_|$)?",
    "FULL_NAME": r"(^|_)(full_?name|customer_?name|name)($)",
    "DOB": r"(^|_)(dob|birth_?date|date_of_birth|birthdate)(_|$)?",
    "PHONE": r"(^|_)(phone|mobile|cell|contact_no|telephone)(_|$)?",
    "FULL_ADDRESS": r"(^|_)(full_?address|mailing_?address|billing_?address|shipping_?address|address_full)(_|$)?|^(address|addr)$",
    "ADDRESS": r"(^|_)(address|addr|street)(_|$)?|address_line",
    "CITY": r"(^|_)city(_|$)?",
    "ZIP": r"(^|_)(zip|postal|pincode|postcode)(_|$)?",
    "STATE": r"(^|_)state(_|$)?",
    "COMPANY": r"(^|_)(company|employer|organization|org_name)(_|$)?",
    "IBAN": r"(^|_)iban(_|$)?",
    "SWIFT_BIC": r"(^|_)(swift|bic|swift_?code|bic_?code)(_|$)?",
    "BANK_ACCOUNT": r"(^|_)(account_?no|account_?num|acct_?no|acct_?num|bank_?account|account_?number|iban)(_|$)?",
    "ROUTING": r"(^|_)(routing|aba|sort_?code|ifsc)(_|$)?",
    "TAX_ID": r"(^|_)(national_?id|tax_?id|tin|ein|vat|pan_?no|pan_?number)(_|$)?",
    "IP_ADDRESS": r"(^|_)(ip|ip_?addr|ip_?address|ipv4|ipv6)(_|$)?",
    "PASSPORT": r"(^|_)(passport|passport_?no|passport_?number)(_|$)?",
    "DRIVER_LICENSE": r"(^|_)(driver_?license|dl_?no|license_?no|licence_?no)(_|$)?",
    "USERNAME": r"(^|_)(username|user_?name|login|userid|user_?id)(_|$)?",
    "PASSWORD": r"(^|_)(password|passwd|pwd|secret|api_?key|token)(_|$)?",
    "MAC_ADDRESS": r"(^|_)(mac|mac_?addr|mac_?address)(_|$)?",
    "GENDER": r"(^|_)(gender|sex)(_|$)?",
    "MEDICAL_RECORD_NUMBER": r"(^|_)(mrn|medical_?record|patient_?record|health_?record)(_|$)?",
    "HEALTH_PLAN_ID": r"(^|_)(health_?plan|member_?health_?id|insurance_?member|beneficiary_?id)(_|$)?",
    "DIAGNOSIS_CODE": r"(^|_)(diagnosis|diagnostic|icd_?10?|icd_?code)(_|$)?",
    "PRESCRIPTION_ID": r"(^|_)(prescription|rx_?id|rx_?number|medication_?order)(_|$)?",
    "BIOMETRIC_ID": r"(^|_)(biometric|fingerprint|face_?template|voice_?print|retina)(_|$)?",
    "GENETIC_DATA": r"(^|_)(genetic|genomic|dna_?profile|gene_?sequence)(_|$)?",
    "CVV": r"(^|_)(cvv|cvc|card_?security_?code)(_|$)?",
    "CARD_EXPIRY": r"(^|_)(card_?expiry|card_?expiration|expiry_?date|expiration_?date)(_|$)?",
    "DEVICE_ID": r"(^|_)(device_?id|advertising_?id|mobile_?device_?id)(_|$)?",
    "COOKIE_ID": r"(^|_)(cookie_?id|tracking_?id|browser_?id)(_|$)?",
    "GEOLOCATION": r"(^|_)(geo_?location|latitude|longitude|gps|location_?coordinates)(_|$)?",
    "RACE_ETHNICITY": r"(^|_)(race|ethnicity|ethnic_?origin)(_|$)?",
    "RELIGION": r"(^|_)(religion|religious_?belief)(_|$)?",
    "FAX": r"(^|_)(fax|facsimile|fax_?number)(_|$)?",
    "AGE": r"(^|_)(age|patient_?age|member_?age|age_?years)(_|$)?",
    "HEALTH_DATE": r"(^|_)(admission|discharge|service|treatment|procedure|death)_?date(_|$)?",
    "HEALTH_DATA": r"(^|_)(medical_?condition|health_?condition|clinical_?note|lab_?result|allergy|treatment_?detail)(_|$)?",
    "PERSON_ID": r"(^|_)(patient|person|consumer|subject|resident)_?(id|identifier|number)(_|$)?",
    "CERTIFICATE_LICENSE": r"(^|_)(certificate|certification|professional_?license|licence|license)_?(id|no|num|number)?(_|$)?",
    "VEHICLE_ID": r"(^|_)(vin|vehicle_?(id|number)|license_?plate|licence_?plate|vehicle_?registration)(_|$)?",
    "URL": r"(^|_)(url|uri|website|web_?address|profile_?url)(_|$)?",
    "PHOTO_IMAGE": r"(^|_)(photo|photograph|facial_?image|profile_?image|patient_?image)(_|$)?",
    "SIGNATURE": r"(^|_)(signature|digital_?signature|signature_?image)(_|$)?",
    "CARD_SERVICE_CODE": r"(^|_)(card_?service_?code|service_?code)(_|$)?",
    "FULL_TRACK_DATA": r"(^|_)(full_?track|track_?1|track_?2|magnetic_?stripe|chip_?track)(_|$)?",
    "PIN_BLOCK": r"(^|_)(pin|pin_?block|encrypted_?pin|card_?pin)(_|$)",
    "ACCOUNT_CREDENTIAL": r"(^|_)(account_?login|login_?credential|authentication_?credential|access_?credential)(_|$)?",
    "POLITICAL_OPINION": r"(^|_)(political_?opinion|political_?affiliation|party_?affiliation)(_|$)?",
    "UNION_MEMBERSHIP": r"(^|_)(union_?membership|trade_?union|labor_?union)(_|$)?",
    "SEXUAL_ORIENTATION": r"(^|_)(sexual_?orientation|sex_?life)(_|$)?",
    "CRIMINAL_RECORD": r"(^|_)(criminal_?record|criminal_?conviction|offense|offence)(_|$)?",
    "EDUCATION_RECORD": r"(^|_)(education_?record|student_?record|transcript|academic_?record)(_|$)?",
    "EMPLOYMENT_DATA": r"(^|_)(employment_?history|employee_?record|job_?history|salary|compensation)(_|$)?",
}
VALUE_HINTS = {
    "EMAIL": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
    "SSN": r"^\d{3}-\d{2}-\d{4}$",
    "CREDIT_CARD": r"^[\d][\d -]{11,21}[\d]$",
    "DOB": r"^\d{4}-\d{2}-\d{2}$|^\d{2}/\d{2}/\d{4}$",
    "PHONE": r"^\+?[\d().\- ]{7,18}$",
    "ZIP": r"^\d{5}-\d{4}$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$",
    "SWIFT_BIC": r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "IP_ADDRESS": r"^(\d{1,3}\.){3}\d{1,3}$|^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$",
    "MAC_ADDRESS": r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "URL": r"^(?i:https?://|www\.)[^\s]+$",
    "VEHICLE_ID": r"^[A-HJ-NPR-Z0-9]{17}$",
}
SUGGESTED = {
    "EMAIL": "EMAIL", "SSN": "SSN", "CREDIT_CARD": "CREDIT_CARD", "FIRST_NAME": "FIRST_NAME",
    "LAST_NAME": "LAST_NAME", "FULL_NAME": "FULL_NAME", "DOB": "DOB_AGE_BAND", "PHONE": "PHONE",
    "FULL_ADDRESS": "ADDRESS_US", "ADDRESS": "ADDRESS_STREET", "CITY": "CITY_STATE_ZIP", "ZIP": "CITY_STATE_ZIP",
    "STATE": "CITY_STATE_ZIP", "COMPANY": "COMPANY", "IBAN": "IBAN", "SWIFT_BIC": "SWIFT_BIC",
    "BANK_ACCOUNT": "BANK_ACCOUNT", "ROUTING": "ABA_ROUTING", "TAX_ID": "NATIONAL_ID", "IP_ADDRESS": "IP_ADDRESS",
    "PASSPORT": "CHARACTER_MAP", "DRIVER_LICENSE": "CHARACTER_MAP", "USERNAME": "TOKENIZE", "PASSWORD": "NULLIFY",
    "MAC_ADDRESS": "MAC_ADDRESS", "GENDER": "SECURE_LOOKUP", "MEDICAL_RECORD_NUMBER": "TOKENIZE",
    "HEALTH_PLAN_ID": "TOKENIZE", "DIAGNOSIS_CODE": "CHARACTER_MAP", "PRESCRIPTION_ID": "TOKENIZE",
    "BIOMETRIC_ID": "TOKENIZE", "GENETIC_DATA": "TOKENIZE", "CVV": "NULLIFY", "CARD_EXPIRY": "CHARACTER_MAP",
    "DEVICE_ID": "TOKENIZE", "COOKIE_ID": "TOKENIZE", "GEOLOCATION": "REDACT", "RACE_ETHNICITY": "REDACT",
    "RELIGION": "REDACT", "FAX": "PHONE", "AGE": "NUMERIC_NOISE", "HEALTH_DATE": "DATE_SHIFT",
    "HEALTH_DATA": "REDACT", "PERSON_ID": "TOKENIZE", "CERTIFICATE_LICENSE": "CHARACTER_MAP",
    "VEHICLE_ID": "TOKENIZE", "URL": "TOKENIZE", "PHOTO_IMAGE": "NULLIFY", "SIGNATURE": "NULLIFY",
    "CARD_SERVICE_CODE": "CHARACTER_MAP", "FULL_TRACK_DATA": "NULLIFY", "PIN_BLOCK": "NULLIFY",
    "ACCOUNT_CREDENTIAL": "NULLIFY", "POLITICAL_OPINION": "REDACT", "UNION_MEMBERSHIP": "REDACT",
    "SEXUAL_ORIENTATION": "REDACT", "CRIMINAL_RECORD": "REDACT", "EDUCATION_RECORD": "REDACT",
    "EMPLOYMENT_DATA": "REDACT",
}
NUMERIC_SAFE = {
    "FORMAT_PRESERVE", "CHARACTER_MAP", "SEQUENCE", "NUMERIC_NOISE", "MIN_MAX", "SSN", "CREDIT_CARD", "PHONE",
    "BANK_ACCOUNT", "ABA_ROUTING",
}
DATE_SAFE = {"DATE_SHIFT", "DOB_AGE_BAND", "AGE"}
ANY_SAFE = {"NULLIFY", "FIXED", "PASSTHROUGH"}
VALUE_SHARE = 0.6


def category(kind: T.DataType) -> str:
    """TEXT, NUMERIC, DATE, BOOLEAN, BINARY or OTHER (nested types, which carry no text to match)."""
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    if isinstance(kind, T.NumericType):
        return "NUMERIC"
    if isinstance(kind, T.BinaryType):
        return "BINARY"
    return "TEXT" if isinstance(kind, T.StringType) else "OTHER"


def safe_function(name: str | None, kind: str) -> str:
    """Suggested mask, or a default that can be written to the column's category."""
    fits = {
        "TEXT": name is not None, "NUMERIC": name in NUMERIC_SAFE, "DATE": name in DATE_SAFE,
    }.get(kind, False)
    if name in ANY_SAFE or fits:
        return name
    return {"NUMERIC": "FORMAT_PRESERVE", "DATE": "DATE_SHIFT", "TEXT": "FORMAT_PRESERVE"}.get(kind, "NULLIFY")


def name_hint(column: str, hints: Mapping[str, str] = NAME_HINTS) -> str | None:
    return next((kind for kind, pattern in hints.items() if re.search(pattern, column, re.I)), None)


def value_test(kind: str, value: Column, named: Column, hints: Mapping[str, str] = VALUE_HINTS) -> Column:
    """Pattern test; cards need the check digit, IBANs country and mod-97, dates a birth-date column name (``named``)."""
    clean = F.trim(value)
    if kind == "CREDIT_CARD":
        digits = F.regexp_replace(clean, "[ -]", "")
        return F.when(digits.rlike(r"^\d{12,19}$"), luhn_valid(digits)).otherwise(F.lit(False))
    if kind == "IBAN":
        return iban_valid(clean, IBAN_COUNTRIES)
    return named & clean.rlike(hints[kind]) if kind == "DOB" else clean.rlike(hints[kind])


def redacted_sample(value: Column) -> Column:
    """Enough of a value to recognise its form: first character and last two, or the domain of an e-mail."""
    v = F.trim(value)
    first = F.substring(v, 1, 1)
    return (
        F.when(v == "", F.lit(None))
        .when(F.locate("@", v) > 1, F.concat(first, F.lit("***"), F.substr(v, F.locate("@", v))))
        .when(F.length(v) <= 2, F.lit("**")).when(F.length(v) <= 4, F.concat(first, F.lit("***")))
        .otherwise(F.concat(first, F.lit("***"), F.substring(v, -2, 2)))
    )


def confidence(named: Column, by_value: Column, share: Column) -> Column:
    """Name and value agree, name only, value only, or they disagree (then the data wins)."""
    score = (
        F.when(named == by_value, 0.6 + 0.4 * share)
        .when(named.isNotNull() & by_value.isNull(), F.lit(0.6))
        .when(named.isNull() & by_value.isNotNull(), 0.4 * share + 0.35)
        .when(named.isNotNull(), 0.4 * share + 0.3)
    )
    return F.least(score, F.lit(0.99))


def text_pairs(df: DataFrame, table: str, names: Mapping[str, str] = NAME_HINTS) -> DataFrame:
    """Each row as (table, column, text) with what the column's name and type say about it."""
    pairs = []
    for f in df.schema.fields:
        kind = category(f.dataType)
        text = F.col(f.name).cast("string") if kind != "OTHER" else F.lit(None).cast("string")
        born = re.search(NAME_HINTS["DOB"], f.name, re.I) is not None
        pairs.append(
            F.struct(
                F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(kind).alias("category"),
                F.lit(name_hint(f.name, names)).cast("string").alias("name_type"), text.alias("text"),
                F.lit(kind in ("TEXT", "DATE")).alias("tested"), F.lit(born).alias("born"),
            )
        )
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def column_scores(
    tables: Mapping[str, DataFrame], names: Mapping[str, str] = NAME_HINTS, values: Mapping[str, str] = VALUE_HINTS
) -> DataFrame:
    """One row per column: rows, hits per value type, a redacted sample.

    One scan per table and one aggregate for all of them: each row becomes (column, text) pairs that are tested once
    and summed before the shuffle, so the plan does not grow with the columns and few counters leave a task.
    """
    long = reduce(DataFrame.unionByName, [text_pairs(df, name, names) for name, df in tables.items()])
    tested = F.when(F.col("tested") & F.col("text").isNotNull(), F.col("text"))
    counted = long.groupBy("table_name", "column_name", "category", "name_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(value_test(t, tested, F.col("born"), values)).alias(f"hits_{i}") for i, t in enumerate(values)],
    )
    hits = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(f"hits_{i}").alias("hits")) for i, t in enumerate(values)])
    scores = counted.select("table_name", "column_name", "category", "name_type", "n_rows", hits.alias("hits"))
    # One value per column for the reviewer: the least text of the whole column, by one aggregate without groups per table.
    shown = reduce(DataFrame.unionByName, [least_texts(df, name) for name, df in tables.items()])
    return scores.join(
        shown.select("table_name", "column_name", redacted_sample(F.col("least")).alias("sample")), ["table_name", "column_name"], "left"
    )


def least_texts(df: DataFrame, table: str) -> DataFrame:
    """``(table_name, column_name, least)``: the least text of each column that is not blank."""
    plain = [f.name for f in df.schema.fields if category(f.dataType) not in ("BINARY", "OTHER")]
    if not plain:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, least string")
    text = lambda c: F.col(c).cast("string")
    least = df.agg(*[F.min(F.when(F.trim(text(c)) != "", text(c))).alias(f"_{i}") for i, c in enumerate(plain)])
    rows = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("least")) for i, c in enumerate(plain)])
    return least.select(F.explode(rows).alias("r")).select("r.*").where("least IS NOT NULL")


def findings(scores: DataFrame) -> DataFrame:
    """Columns that hold personal data, with type, confidence and a mask that fits the column."""
    best = F.reduce(
        F.col("hits"), F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).cast("bigint").alias("hits")),
        lambda a, b: F.when(b["hits"] > a["hits"], b).otherwise(a),
    )
    share = F.col("best.hits") / F.greatest(F.col("n_rows"), F.lit(1))
    strong = share >= VALUE_SHARE
    scored = scores.withColumn("best", best).withColumn("value_type", F.when(strong, F.col("best.kind"))).withColumn(
        "value_share", F.when(strong, share).otherwise(F.lit(0.0))
    )
    scored = scored.withColumn("pii_type", F.coalesce("value_type", "name_type")).where("pii_type IS NOT NULL")
    entries = [
        f"'{pii}/{kind}', '{safe_function(fn, kind)}'"
        for pii, fn in SUGGESTED.items()
        for kind in ("TEXT", "NUMERIC", "DATE", "BOOLEAN", "BINARY", "OTHER")
    ]
    safe = F.expr(f"map({', '.join(entries)})")
    suggested = F.try_element_at(safe, F.concat_ws("/", "pii_type", "category"))
    return scored.select(
        "table_name", "column_name", "category", "pii_type",
        F.round(confidence(F.col("name_type"), F.col("value_type"), F.col("value_share")), 4).alias("confidence"),
        F.coalesce(suggested, F.lit("FORMAT_PRESERVE")).alias("suggested_function"), "n_rows",
        F.col("best.hits").alias("value_hits"), "sample",
    )


def discover(tables: Mapping[str, DataFrame], **hints) -> DataFrame:
    """Findings of several tables."""
    return findings(column_scores(tables, **hints))


def leaf_findings(df: DataFrame, table: str, column: str, form: str = "marks") -> DataFrame:
    """Personal data in the leaves of marked or XML values: rows per (path, type) with its share of the path."""
    if form == "xml":
        leaves = xml_leaves(F.col(column))
    else:
        leaves = marked_leaves(F.col(column))
    rows = df.select(F.explode(leaves).alias("leaf")).select("leaf.path", "leaf.text").where(F.trim("text") != "")
    tests = F.filter(
        F.array(*[F.when(value_test(t, F.col("text"), F.lit(re.search(NAME_HINTS["DOB"], column, re.I) is not None)), F.lit(t)) for t in VALUE_HINTS]), lambda x: x.isNotNull()
    )
    counted = rows.withColumn("kinds", tests).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.array_contains("kinds", t)).alias(t) for t in VALUE_HINTS],
    )
    long = counted.select(
        "path", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("pii_type"), F.col(t).alias("hits")) for t in VALUE_HINTS])).alias("k")
    )
    share = F.col("k.hits") / F.col("n")
    return long.where(share >= VALUE_SHARE).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "path", F.col("k.pii_type").alias("pii_type"),
        F.col("n").alias("leaves"), F.round(share, 4).alias("share"),
    )


def marked_leaves(value: Column) -> Column:
    """Array of (path, text) with 1-based field.value paths."""
    fields = F.transform(
        F.split(value, MARKS[0], -1),
        lambda f, i: F.transform(
            F.split(f, f"[{MARKS[1:]}]", -1),
            lambda v, j: F.struct(F.concat_ws(".", (i + 1).cast("string"), (j + 1).cast("string")).alias("path"), v.alias("text")),
        ),
    )
    return F.flatten(fields)


def xml_leaves(value: Column) -> Column:
    """Array of (path, text) for the text of each element (``a/b``) and each attribute (``a/b@name``)."""
    path = lambda p: F.replace(F.substr(p, F.lit(3)), F.lit("."), F.lit("/"))
    return F.transform(leaves(value, "xml"), lambda x: F.struct(path(x["path"]).alias("path"), x["text"].alias("text")))


def rescan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge of earlier and fresh findings: reviewed rows stay, suggestions are refreshed, stale ones drop."""
    keys = ["table_name", "column_name"]
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("pii_type", "confidence", "suggested_function", "status")])
    n = new.select(*keys, "pii_type", "confidence", "suggested_function")
    both = o.join(n, keys, "full_outer")
    kept = F.col("old_status").isin("APPROVED", "REJECTED", "OVERRIDDEN", "OUT_OF_SCOPE")
    both = both.where(kept | F.col("pii_type").isNotNull())
    columns = [F.when(kept, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("pii_type", "confidence", "suggested_function")]
    return both.select(*keys, *columns, F.when(kept, F.col("old_status")).otherwise(F.lit("SUGGESTED")).alias("status"))


# ---------------------------------------------------------------- profiles

LOW_CARDINALITY = 25  # fixed value: most distinct values of a column that is drawn by weight; a plan lists all of them
TOP_VALUES = 12  # fixed value: values that a report on a column shows


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value) for many columns at once; counted before the shuffle, nulls included."""
    names = list(columns or df.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names]))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("rows"))


def column_profile(counts: DataFrame) -> DataFrame:
    """Rows, non-null rows, distinct values and null rate per column."""
    full = F.col("value").isNotNull()
    return counts.groupBy("column_name").agg(
        F.sum("rows").alias("n_rows"), F.coalesce(F.sum(F.when(full, F.col("rows"))), F.lit(0)).alias("non_null"),
        F.count_if(full).alias("distinct_values"),
        F.round(F.coalesce(F.sum(F.when(~full, F.col("rows"))), F.lit(0)) / F.sum("rows"), 3).alias("null_rate"),
    )


def numeric_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and standard deviation of every numeric column in one pass."""
    names = [f.name for f in df.schema.fields if category(f.dataType) == "NUMERIC"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, low double, high double, mean double, spread double")
    measures = []
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        measures += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"c{i}"), F.stddev_samp(x).alias(f"d{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"a{i}").alias("low"), F.col(f"b{i}").alias("high"),
            F.round(f"c{i}", 6).alias("mean"), F.round(f"d{i}", 4).alias("spread"),
        )
        for i, c in enumerate(names)
    ]
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_values(counts: DataFrame, most: int = LOW_CARDINALITY) -> DataFrame:
    """Most frequent values per column."""
    ranked = top_in_group(counts.where("value IS NOT NULL"), ["column_name"], [F.col("rows").desc(), F.col("value")], most, "place")
    return ranked.select("column_name", "value", "rows", "place")


def date_ranges(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if category(f.dataType) == "DATE"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, first date, last date")
    measures = [m for i, c in enumerate(names) for m in (F.min(c).cast("date").alias(f"a{i}"), F.max(c).cast("date").alias(f"b{i}"))]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("first"), F.col(f"b{i}").alias("last")) for i, c in enumerate(names)]
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def percent_true(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of true-like values per column, in whole percent."""
    measures = [
        F.round(F.avg(F.coalesce(F.col(c).cast("string").isin("t", "true", "1", "TRUE", "T", "Y"), F.lit(False)).cast("int")) * 100).cast("int").alias(f"p{i}")
        for i, c in enumerate(columns)
    ]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"p{i}").alias("percent_true")) for i, c in enumerate(columns)]
    return df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Words in a column name that make its source values sensitive, with a safe generator.
SENSITIVE_WORDS = [
    ("ssn|social security|tax id|tin|national id|govt id|government id", "PII_TAX_ID", "ALPHANUMERIC"),
    ("email|mail|emailaddress|email address", "PII_EMAIL", "EMAIL"),
    ("phone|mobile|cell|telephone|tel", "PII_PHONE", "PHONE_US"),
    ("iban", "FINANCIAL_ACCOUNT", "IBAN_LIKE"),
    ("bic|swift", "FINANCIAL_ACCOUNT", "BIC"),
    ("routing|aba", "FINANCIAL_ACCOUNT", "ROUTING_NUMBER_US"),
    ("credit score|credit rating|risk score", "BANKING_CONTROL", None),
    ("card|pan|payment card|debit card|credit card", "PCI_CARD", "CREDIT_CARD_VISA"),
    ("account|acct", "FINANCIAL_ACCOUNT", "ACCOUNT_NUMBER"),
    ("dob|birth|birthdate|date of birth", "PII_DOB", "DOB_ADULT"),
    ("first name|fname|given name", "PII_NAME", "FIRST_NAME"),
    ("last name|lname|surname|family name", "PII_NAME", "LAST_NAME"),
    ("name|customer name|full name|cardholder", "PII_NAME", "FULL_NAME"),
    ("address|addr|street", "PII_ADDRESS", "STREET_ADDRESS"),
    ("city", "PII_ADDRESS", "CITY_BY_COUNTRY"),
    ("zip|postal|postcode|pincode|pin code", "PII_ADDRESS", "POSTAL_BY_COUNTRY"),
    ("merchant|payee|beneficiary|counterparty", "TRANSACTION_DESCRIPTOR", "COMPANY"),
    ("description|descriptor|memo|narrative|narration|remittance", "TRANSACTION_DESCRIPTOR", "LOREM_SENTENCE"),
    (
        "balance|amount|limit|income|salary|payment|fee|interest|rate|exposure|delinquency|chargeback",
        "FINANCIAL_VALUE", None,
    ),
    ("kyc|aml|sanction|risk|fraud", "BANKING_CONTROL", None),
]
# Words of a technical identifier, words whose values may be kept, and generators by name.
TECHNICAL_WORDS = "id|key|pk"
GENDER_WORDS = {"FEMALE_FIRST_NAME": "female|mother|wife|daughter|girl", "MALE_FIRST_NAME": "male|father|husband|son|boy"}
SAFE_WORDS = "status|state|type|code|flag|indicator|category|channel|currency|method|frequency|reason|source system"
NAME_GENERATORS = [
    ("email|mail", "EMAIL"), ("phone|mobile|tel", "PHONE_US"), ("first", "FIRST_NAME"), ("last|surname", "LAST_NAME"),
    ("name", "FULL_NAME"), ("city", "CITY"), ("state|province", "STATE"), ("zip|postal", "ZIP"),
    ("street|address|addr", "STREET_ADDRESS"), ("country", "COUNTRY_CODE"), ("ssn", "SSN"), ("iban", "IBAN_LIKE"),
    ("bic|swift", "BIC"), ("account|acct", "ACCOUNT_NUMBER"), ("routing", "ROUTING_NUMBER_US"),
    ("card", "CREDIT_CARD_VISA"), ("company|org|employer", "COMPANY"), ("status", "STATUS"), ("uuid|guid", "UUID"),
    ("ip", "IPV4"), ("url|link", "URL"),
]


def sensitivity(column: str, number: bool = False) -> tuple[str, str | None] | None:
    """Category and safe generator of a column whose source values must not be kept; None when they may.

    Tax numbers come first: no other word in a name makes their values safe. Then technical identifiers, which are no personal
    data but point at the source's rows, so a sequence takes their place; then safe words.
    """
    words = " " + re.sub(r"[^a-z0-9]+", " ", column.lower()) + " "
    holds = lambda pattern: re.search(rf" ({pattern}) ", words) is not None
    tax, *others = SENSITIVE_WORDS
    if holds(tax[0]):
        return tax[1], "SSN" if "ssn" in words else tax[2]
    if holds(TECHNICAL_WORDS):
        return "TECHNICAL_IDENTIFIER", "SEQUENCE" if number else "PADDED_SEQUENCE"
    if holds(SAFE_WORDS):
        return None
    found = next(((kind, gen) for pattern, kind, gen in others if holds(pattern)), None)
    if found and found[0] in ("PII_NAME", "TRANSACTION_DESCRIPTOR") or found is None:
        gendered = next((gen for gen, pattern in GENDER_WORDS.items() if holds(pattern)), None)
        if gendered and holds("first|name"):
            return "PII_NAME", gendered
    return found


def generator_for_name(column: str) -> str:
    return next((gen for pattern, gen in NAME_GENERATORS if re.search(pattern, column.lower())), "ALPHANUMERIC")


def recommend(df: DataFrame, keys: Sequence[str] = (), keep_safe: bool = True) -> DataFrame:
    """Generator per column from its profile; with ``keep_safe`` sensitive columns never keep source values."""
    counts = value_counts(df)
    profile = column_profile(counts)
    stats, dates = numeric_stats(df), date_ranges(df)
    listed = top_values(counts, LOW_CARDINALITY).groupBy("column_name").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("place", F.translate("value", "|:", "  ").alias("value"), "rows"))),
                lambda x: F.concat(F.trim(x["value"]), F.lit(":"), x["rows"].cast("string")),
            ), "|",
        ).alias("weights")
    )
    facts = []
    for f in df.schema.fields:
        risk = sensitivity(f.name, category(f.dataType) == "NUMERIC") if keep_safe else None
        whole = isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        facts.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(category(f.dataType)).alias("category"), F.lit(whole).alias("whole"),
                F.lit(f.name in keys).alias("is_key"), F.lit(risk is not None).alias("sensitive"),
                F.lit(risk[0] if risk else None).cast("string").alias("sensitivity"),
                F.lit(risk[1] if risk else None).cast("string").alias("safe_generator"),
                F.lit(generator_for_name(f.name)).alias("by_name"),
            )
        )
    base = profile.join(
        F.broadcast(df.sparkSession.range(1).select(F.explode(F.array(*facts)).alias("f")).select("f.*")), "column_name"
    )
    wide = base.join(stats, "column_name", "left").join(dates, "column_name", "left").join(listed, "column_name", "left")
    unique = F.col("is_key") | ((F.col("non_null") > 0) & (F.col("distinct_values") >= F.col("non_null")))
    number = F.col("category") == "NUMERIC"
    few = ~F.col("sensitive") & F.col("distinct_values").between(1, LOW_CARDINALITY)
    spread = F.coalesce(F.col("spread"), F.lit(0.0)) > 0
    generator = (
        F.when(unique & number, "SEQUENCE").when(unique, "PADDED_SEQUENCE")
        .when(F.col("safe_generator").isNotNull(), F.col("safe_generator"))
        .when(number & few, "WEIGHTED")
        .when(number & F.col("whole") & spread, "NORMAL_INT").when(number & F.col("whole"), "INT_RANGE")
        .when(number & spread, "NORMAL_DECIMAL").when(number, "DECIMAL_RANGE")
        .when(F.col("category") == "DATE", "DATE_BETWEEN").when(F.col("category") == "BOOLEAN", "BOOLEAN_WEIGHTED")
        .when(few, "WEIGHTED").otherwise(F.col("by_name"))
    )
    g = F.col("generator")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    p1 = (
        F.when(g == "PADDED_SEQUENCE", "12").when(g == "WEIGHTED", F.col("weights"))
        .when(g == "NORMAL_INT", F.round("mean").cast("bigint").cast("string")).when(g == "INT_RANGE", F.col("low").cast("bigint").cast("string"))
        .when(g == "NORMAL_DECIMAL", money("mean")).when(g == "DECIMAL_RANGE", money("low"))
        .when(g == "DATE_BETWEEN", F.col("first").cast("string")).otherwise("")
    )
    p2 = (
        F.when(g == "NORMAL_INT", F.round("spread").cast("bigint").cast("string")).when(g == "INT_RANGE", F.col("high").cast("bigint").cast("string"))
        .when(g == "NORMAL_DECIMAL", money("spread")).when(g == "DECIMAL_RANGE", money("high"))
        .when(g == "DATE_BETWEEN", F.col("last").cast("string")).otherwise("")
    )
    return wide.withColumn("generator", generator).select(
        "column_name", "category", "null_rate", "distinct_values", "generator", p1.alias("param1"), p2.alias("param2"),
        "sensitivity", F.when(F.col("sensitive"), "suppressed").when(g == "WEIGHTED", "used").alias("source_values"),
    )
