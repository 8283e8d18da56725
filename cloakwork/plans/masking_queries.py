"""Masking functions over whole tables; inputs are derived from the given columns."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from cloakwork.functions import masks, structured
from cloakwork.functions import wordlists as words
from cloakwork.functions.keyed import characters, luhn_digit, luhn_valid
from cloakwork.functions.masks import Row, mask, register_mask
from cloakwork.operators import mapping as ops
from cloakwork.operators.policy import lookup_by_table, pick_by_table
from cloakwork.plans import sqltext as sql
from cloakwork.plans.keys import KEY
from cloakwork.plans.registry import query
from cloakwork.session import spread

# Inputs as expressions that both engines read the same way.
SSN_DIGITS = "cast(100000000 + (c_custkey * 7919) % 800000000 as string)"
SSN_DASHED = f"substr({SSN_DIGITS}, 1, 3) || '-' || substr({SSN_DIGITS}, 4, 2) || '-' || substr({SSN_DIGITS}, 6, 4)"
PHONE = "'(2' || lpad(cast((c_custkey * 37) % 100 as string), 2, '0') || ') ' || lpad(cast((c_custkey * 7919) % 1000 as string), 3, '0') || '-' || lpad(cast(c_custkey % 10000 as string), 4, '0')"
PHONE_DIGITS = f"regexp_replace({PHONE}, '[^0-9]', '')"
ACCOUNT = "lpad(cast(c_custkey * 104729 as string), 12, '0')"
EMAIL_IN = "'user' || cast(c_custkey as string) || '@corp.com'"
ORDER_DAY = "substr(cast(o_orderdate as string), 1, 10)"
MAC_IN = "substr(md5(cast(c_custkey as string)), 1, 2) || ':' || substr(md5(cast(c_custkey as string)), 3, 2) || ':' || substr(md5(cast(c_custkey as string)), 5, 2) || ':' || substr(md5(cast(c_custkey as string)), 7, 2) || ':' || substr(md5(cast(c_custkey as string)), 9, 2) || ':' || substr(md5(cast(c_custkey as string)), 11, 2)"
HEX32 = "md5(cast(c_custkey as string))"
UUID_IN = f"substr({HEX32}, 1, 8) || '-' || substr({HEX32}, 9, 4) || '-' || substr({HEX32}, 13, 4) || '-' || substr({HEX32}, 17, 4) || '-' || substr({HEX32}, 21, 12)"


def strip(text: str) -> str:
    """Global digit filter for the SQL side (its regexp_replace needs a flag)."""
    return text.replace("'[^0-9]', '')", "'[^0-9]', '', 'g')")


def add(name, fn, table, key, value, out_sql, p1=None, p2=None, salt=None):
    """Register one mask over one table: key column and masked value."""
    sql_text = None
    if out_sql is not None:
        sql_text = f"SELECT {key}, {out_sql} AS masked FROM (SELECT *, {strip(value)} AS v FROM {table}) t"

    @query(name, sql_text)
    def build(t):
        rows = spread(getattr(t, table).select(key, F.expr(value).alias("v")))
        return rows.select(key, mask(fn, F.col("v"), KEY, salt, p1, p2).alias("masked"))


add("mask_first_name", "FIRST_NAME", "customer", "c_custkey", "c_name", sql.first_name(KEY, "name.first", "v"))
add("mask_first_name_upper", "FIRST_NAME", "supplier", "s_suppkey", "s_name", f"upper({sql.first_name(KEY, 'name.first', 'v')})", "UPPER")
add("mask_last_name", "LAST_NAME", "customer", "c_custkey", "c_name", sql.last_name(KEY, "name.last", "v"))
add("mask_company", "COMPANY", "supplier", "s_suppkey", "s_name", sql.pick(KEY, "company|companies.txt", sql.normal("v"), words.COMPANIES))

TWO_TOKENS = "split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)"
FIRST_TOKEN, LAST_TOKEN = "split_part(v, ' ', 1)", "split_part(v, ' ', 2)"
add(
    "mask_full_name", "FULL_NAME", "part", "p_partkey", TWO_TOKENS,
    f"{sql.first_name(KEY, 'name.first', FIRST_TOKEN)} || ' ' || {sql.last_name(KEY, 'name.last', LAST_TOKEN)}",
)
add(
    "mask_full_name_last_first", "FULL_NAME", "part", "p_partkey", TWO_TOKENS,
    f"{sql.last_name(KEY, 'name.last', LAST_TOKEN)} || ', ' || {sql.first_name(KEY, 'name.first', FIRST_TOKEN)}", "LAST, FIRST",
)

LOCAL = "split_part(v, '@', 1)"
DOMAIN = sql.pick(KEY, "email|email.dom", sql.normal("v"), words.SAFE_DOMAINS)
SUFFIX = f"{sql.index(KEY, 'email|email.sfx', sql.normal('v'), 10000)}::VARCHAR"
add(
    "mask_email", "EMAIL", "customer", "c_custkey", EMAIL_IN,
    f"lower({sql.first_name(KEY, 'name.first', LOCAL)} || '.' || {sql.last_name(KEY, 'name.last', LOCAL)}) || {SUFFIX} || '@' || {DOMAIN}",
)
add(
    "mask_email_user_keep_domain", "EMAIL", "customer", "c_custkey", EMAIL_IN,
    f"lower({sql.first_name(KEY, 'email.user', LOCAL)}) || {SUFFIX} || '@corp.com'", "USER_SAFE", "PRESERVE_DOMAIN",
)
add(
    "mask_email_hash", "EMAIL", "customer", "c_custkey", EMAIL_IN,
    f"'user' || lpad({sql.index(KEY, 'email|email.hash', sql.normal('v'), 1000000)}::VARCHAR, 6, '0') || '@' || {DOMAIN}", "HASH_LOCAL",
)
add("mask_email_redact", "EMAIL", "customer", "c_custkey", EMAIL_IN, f"'masked@' || {DOMAIN}", "REDACT_LOCAL")

# phone: area code by position, reserved line 555-0100..0199
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
SLOT = sql.index(KEY, "phone|phone.nanp.area", DIGITS, masks.AREA_CODES)
SHIFTED = f"(CASE WHEN {SLOT} < 351 THEN {SLOT} ELSE {SLOT} + 1 END)"
AREA = f"(200 + ({SHIFTED} // 99) * 100 + CASE WHEN {SHIFTED} % 99 < 11 THEN {SHIFTED} % 99 ELSE {SHIFTED} % 99 + 1 END)::VARCHAR"
LINE = sql.index(KEY, "phone|phone.nanp.line", DIGITS, 100)
add("mask_phone", "PHONE", "customer", "c_custkey", PHONE, f"'(' || {AREA} || ') 555-' || lpad((100 + {LINE})::VARCHAR, 4, '0')")
add("mask_phone_digits_only", "PHONE", "customer", "c_custkey", PHONE, f"{AREA} || '555' || lpad((100 + {LINE})::VARCHAR, 4, '0')", "DIGITS_ONLY")
add("mask_phone_keep_last4", "PHONE", "customer", "c_custkey", PHONE, "'(XXX) XXX-' || right(v, 4)", "KEEP_LAST4")
add("mask_phone_redact", "PHONE", "customer", "c_custkey", PHONE, "regexp_replace(v, '[0-9]', '*', 'g')", "REDACT")
add(
    "mask_phone_keep_area", "PHONE", "customer", "c_custkey", PHONE,
    f"'(' || CASE WHEN substr(v, 2, 3) = '211' THEN {AREA} ELSE substr(v, 2, 3) END || ') 555-' || lpad((100 + {LINE})::VARCHAR, 4, '0')", "PRESERVE_AREA",
)

SSN_DRAWS = sql.draws(KEY, "ssn|ssn", DIGITS)
GROUP = f"lpad((1 + {sql.draw(SSN_DRAWS, 0, 99)})::VARCHAR, 2, '0')"
SERIAL = f"lpad((1 + {sql.draw(SSN_DRAWS, 1, 9999)})::VARCHAR, 4, '0')"
OWN_AREA = "CASE WHEN substr(v, 1, 3) IN ('000', '666') THEN '899' ELSE substr(v, 1, 3) END"
RANDOM_AREA = f"lpad((CASE WHEN 1 + {sql.draw(SSN_DRAWS, 2, 898)} >= 666 THEN 2 ELSE 1 END + {sql.draw(SSN_DRAWS, 2, 898)})::VARCHAR, 3, '0')"
add("mask_ssn", "SSN", "customer", "c_custkey", SSN_DASHED, f"{OWN_AREA} || '-' || {GROUP} || '-' || {SERIAL}")
add("mask_ssn_random_area_digits", "SSN", "customer", "c_custkey", SSN_DIGITS, f"{RANDOM_AREA} || {GROUP} || {SERIAL}", "VALID_RANDOM_AREA", "DIGITS_ONLY")
add("mask_ssn_keep_last4", "SSN", "customer", "c_custkey", SSN_DASHED, "'***-**-' || right(v, 4)", "KEEP_LAST4", "DASHED")

DAY_SHIFT = f"(-30 + {sql.number(KEY, 'o_orderdate|dshift', 'v')} % 61)"
add(
    "mask_date_shift", "DATE_SHIFT", "orders", "o_orderkey", ORDER_DAY,
    f"strftime(v::DATE + (CASE WHEN {DAY_SHIFT} = 0 THEN 1 ELSE {DAY_SHIFT} END)::INT, '%Y-%m-%d')", "30", salt="o_orderdate",
)
DOB_DRAWS = sql.draws(KEY, "dob|dob", "v")
add(
    "mask_dob_age_band", "DOB_AGE_BAND", "orders", "o_orderkey", ORDER_DAY,
    f"strftime(make_date(year(v::DATE) - year(v::DATE) % 5 + {sql.draw(DOB_DRAWS, 0, 5)}, 1 + {sql.draw(DOB_DRAWS, 1, 12)}, 1 + {sql.draw(DOB_DRAWS, 2, 28)}), '%Y-%m-%d')", "5",
)
add(
    "mask_age_shift", "AGE", "orders", "o_orderkey", ORDER_DAY,
    "strftime((v::DATE + INTERVAL 12 MONTH - INTERVAL 2 MONTH + INTERVAL 31 DAY)::DATE, '%Y-%m-%d')", "+1y -2m +3w +10d",
)


def street(salt):
    d = sql.draws(KEY, f"{salt}|street", sql.normal("v"))
    place = sql.draw(d, 1, words.STREET_SIZE)
    return f"(1 + {sql.draw(d, 0, 9899)})::VARCHAR || ' ' || {sql.name_at(words.STREET_NAMES, words.STREET_KINDS, place, ' ')}"


CITY = sql.pick(KEY, "geo.triplet|any", sql.normal("v"), words.CITIES)
CITY_TEXT = f"split_part({CITY}, ',', 1) || ', ' || split_part({CITY}, ',', 2) || ' ' || split_part({CITY}, ',', 3)"
add("mask_street", "ADDRESS_STREET", "customer", "c_custkey", "c_name", street("addr"))
UNIT = f"(100 + {sql.draw(sql.draws(KEY, 'addr.us|line2', sql.normal('v')), 0, 899)})::VARCHAR"
add(
    "mask_us_address", "ADDRESS_US", "customer", "c_custkey", "c_name",
    f"{street('addr.us.line1')} || ', Apt ' || {UNIT} || ', ' || {CITY_TEXT} || ', USA'",
)
add("mask_city_state_zip", "CITY_STATE_ZIP", "customer", "c_custkey", "c_name", CITY_TEXT)
TEXAS = [c for c in words.CITIES if ",TX," in c]
IN_TEXAS = sql.pick(KEY, "geo.triplet|TX", sql.normal("v"), TEXAS)
add(
    "mask_city_keep_state", "CITY_STATE_ZIP", "customer", "c_custkey", "'Town ' || cast(c_custkey as string) || ', TX 75000'",
    f"split_part({IN_TEXAS}, ',', 1) || ', TX ' || split_part({IN_TEXAS}, ',', 3)", "FULL", "PRESERVE_STATE",
)
add("mask_format_preserve", "FORMAT_PRESERVE", "customer", "c_custkey", "c_name", sql.keep_format(KEY, "c_name", "v"), salt="c_name")
MAPPED = sql.keep_format(KEY, "p_brand|character-map", "v")
add(
    "mask_character_map", "CHARACTER_MAP", "part", "p_partkey", "p_name || '/' || p_brand",
    f"substr(v, 1, 2) || substr({MAPPED}, 3, length(v) - 5) || right(v, 3)", "FIRST:2,LAST:3", salt="p_brand",
)
add("mask_tokenize", "TOKENIZE", "orders", "o_orderkey", "cast(o_custkey as string)", f"'TKN_' || substr({sql.digest(KEY, 'cust|token', sql.normal('v'))}, 1, 32)", salt="cust")
SEGMENTS = ["Retail", "Wholesale", "Online"]
add("mask_secure_lookup", "SECURE_LOOKUP", "customer", "c_custkey", "c_name", sql.pick(KEY, "seg|secure-lookup", sql.normal("v"), SEGMENTS), "|".join(SEGMENTS), salt="seg")
add(
    "mask_direct_lookup", "DIRECT_LOOKUP", "customer", "c_custkey", "c_mktsegment",
    "CASE v WHEN 'BUILDING' THEN 'B1' WHEN 'MACHINERY' THEN 'M1' ELSE regexp_replace(v, '[A-Za-z0-9]', '*', 'g') END",
    "building=>B1|machinery=>M1", "CASE=UPPER;NOT_FOUND=REDACT",
)
NAMED_ROWS = "1=Ann~Lee|2=Bob~Ray|3=Cyd~Fox|-1=Nobody~None"
LOOKUP_MARK = hmac.new(KEY.secret.encode(), b"lookup-definition\x1f" + NAMED_ROWS.encode(), hashlib.sha256).hexdigest()[:16]
add(
    "mask_hash_lookup", "HASH_LOOKUP", "orders", "o_orderkey", "nullif(o_orderpriority, '5-LOW')",
    f"CASE WHEN v IS NULL THEN 'None' ELSE {sql.pick(KEY, f'hash-lookup|inline:{LOOKUP_MARK}|seed=7', 'v', ['Lee', 'Ray', 'Fox'])} END",
    NAMED_ROWS, "SEED=7;VALUE=2",
)
add("mask_redact_full", "REDACT", "customer", "c_custkey", "c_name", "repeat('*', length(v))")
add("mask_redact_keep_ends", "REDACT", "customer", "c_custkey", "c_name", "substr(v, 1, 2) || '######' || '#' || '#####' || right(v, 4)", "#", "KEEP_FIRST2_LAST4")
add("mask_redact_standard", "REDACT", "customer", "c_custkey", "c_name", "'XXXXXXXX'", "X", "STANDARD:8")
add("mask_redact_keep_last4", "REDACT_KEEP_LAST4", "part", "p_partkey", "p_brand", "CASE WHEN length(v) <= 4 THEN '****' ELSE repeat('*', least(length(v) - 4, 12)::BIGINT) || right(v, 4) END")

CENTS = "cast(cast(c_acctbal as decimal(14,2)) as string)"
NOISE_UNIT = f"(('0x' || substr({sql.draws(KEY, 'bal|numeric-noise', sql.normal('v'))}, 1, 8))::UBIGINT::DOUBLE / 4294967296)"
NOISE_SHARE = f"round(2.0::DOUBLE * {NOISE_UNIT} - 1.0, 8)::DECIMAL(10,8)"
add(
    "mask_numeric_noise", "NUMERIC_NOISE", "customer", "c_custkey", CENTS,
    f"(round(v::DECIMAL(28,8) + ((abs(v::DECIMAL(18,2)) * 0.1::DECIMAL(4,2))::DECIMAL(24,4) * {NOISE_SHARE})::DECIMAL(28,8), 2))::DECIMAL(28,2)::VARCHAR",
    "PERCENT:10", salt="bal",
)
RANGE_UNIT = f"(('0x' || substr({sql.draws(KEY, 'bal|min-max', sql.normal('v'))}, 1, 8))::UBIGINT::DOUBLE / 4294967296)"
add(
    "mask_min_max", "MIN_MAX", "customer", "c_custkey", CENTS,
    f"(round(100::DECIMAL(28,8) + (400::DECIMAL(24,4) * round({RANGE_UNIT}, 8)::DECIMAL(10,8))::DECIMAL(28,8), 2))::DECIMAL(28,2)::VARCHAR",
    "100", "500", salt="bal",
)
ACCOUNT_STREAM = sql.stream(KEY, "bank.account|account", "v")
add(
    "mask_bank_account", "BANK_ACCOUNT", "customer", "c_custkey", ACCOUNT,
    "array_to_string(list_transform(range(0, 8), lambda i: " + sql.stream_draw(ACCOUNT_STREAM.replace("lambda b:", "lambda b:"), "i", 10) + "::VARCHAR), '') || right(v, 4)",
)

IBAN_IN = "'DE89' || lpad(cast(c_custkey * 104729 as string), 18, '0')"
IBAN_STREAM = sql.stream(KEY, "iban|iban", "v")
BBAN = "array_to_string(list_transform(range(0, 18), lambda i: " + sql.stream_draw(IBAN_STREAM, "i", 10) + "::VARCHAR), '')"
add(
    "mask_iban", "IBAN", "customer", "c_custkey", IBAN_IN,
    f"'DE' || lpad((98 - ({BBAN} || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || {BBAN}",
)
BIC_IN = "'DEUTDE' || lpad(cast(c_custkey % 100 as string), 2, '0') || 'X' || lpad(cast(c_custkey % 97 as string), 2, '0')"
BIC_STREAM = sql.stream(KEY, "swift.bic|bic", "v || repeat('x', 5)").replace("encode(v || repeat('x', 5))", "encode(v)")
add(
    "mask_swift_bic", "SWIFT_BIC", "customer", "c_custkey", BIC_IN,
    "array_to_string(list_transform(range(0, 4), lambda i: chr((65 + " + sql.stream_draw(BIC_STREAM, "i", 26) + ")::INT)), '') || 'DE' || "
    "array_to_string(list_transform(range(5, 10), lambda i: CASE WHEN " + sql.stream_draw(BIC_STREAM, "i", 36) + " < 26 THEN chr((65 + "
    + sql.stream_draw(BIC_STREAM, "i", 36) + ")::INT) ELSE chr((22 + " + sql.stream_draw(BIC_STREAM, "i", 36) + ")::INT) END), '')",
)
ABA_DRAWS = sql.draws(KEY, "routing.aba|aba", "v")
ABA_BODY = f"(({sql.listing(masks.ABA_PREFIXES)})[{sql.draw(ABA_DRAWS, 0, 24)} + 1] || lpad({sql.draw(ABA_DRAWS, 1, 1000000)}::VARCHAR, 6, '0'))"
ABA_SUM = " + ".join(f"substr({ABA_BODY}, {i + 1}, 1)::INT * {w}" for i, w in enumerate([3, 7, 1, 3, 7, 1, 3, 7]))
add("mask_aba_routing", "ABA_ROUTING", "customer", "c_custkey", SSN_DIGITS, f"{ABA_BODY} || ((10 - ({ABA_SUM}) % 10) % 10)::VARCHAR")
UK_IN = "'AB' || lpad(cast((c_custkey * 7919) % 1000000 as string), 6, '0') || 'C'"
UK_DRAWS = sql.draws(KEY, "national.id|nid.uk", "v")
UK_LIST = sql.listing(masks.UK_LETTERS)
add(
    "mask_national_id_uk", "NATIONAL_ID", "customer", "c_custkey", UK_IN,
    f"({UK_LIST})[{sql.draw(UK_DRAWS, 0, 19)} + 1] || ({UK_LIST})[{sql.draw(UK_DRAWS, 1, 19)} + 1] || lpad({sql.draw(UK_DRAWS, 2, 1000000)}::VARCHAR, 6, '0') || (['A','B','C','D'])[{sql.draw(UK_DRAWS, 3, 4)} + 1]", "UK",
)
CA_BODY = f"lpad({sql.draw(sql.draws(KEY, 'national.id|nid.ca', 'v'), 0, 100000000)}::VARCHAR, 8, '0')"
CA_SUM = " + ".join(
    f"substr({CA_BODY}, {i + 1}, 1)::INT" if i % 2 == 0 else f"((substr({CA_BODY}, {i + 1}, 1)::INT * 2) // 10 + (substr({CA_BODY}, {i + 1}, 1)::INT * 2) % 10)"
    for i in range(8)
)
add("mask_national_id_ca", "NATIONAL_ID", "customer", "c_custkey", SSN_DIGITS, f"{CA_BODY} || ((10 - ({CA_SUM}) % 10) % 10)::VARCHAR", "CA")
IP_IN = "'10.' || cast(c_custkey % 256 as string) || '.' || cast((c_custkey * 7) % 256 as string) || '.9'"
IP_DRAWS = sql.draws(KEY, "network.ip|ip", "v")
add("mask_ip_private", "IP_ADDRESS", "customer", "c_custkey", IP_IN, f"'10.' || {sql.draw(IP_DRAWS, 0, 256)} || '.' || {sql.draw(IP_DRAWS, 1, 256)} || '.' || (1 + {sql.draw(IP_DRAWS, 2, 254)})")
add(
    "mask_ip_documentation_range", "IP_ADDRESS", "customer", "c_custkey", IP_IN.replace("'10.'", "'81.'"),
    f"({sql.listing(masks.DOCUMENTATION_NETS)})[{sql.draw(IP_DRAWS, 3, 3)} + 1] || '.' || (1 + {sql.draw(IP_DRAWS, 2, 254)})",
)
MAC_DIGEST = sql.draws(KEY, "network.mac|mac", "replace(v, ':', '')")
MAC_TEXT = f"(substr({MAC_DIGEST}, 1, 1) || translate(substr({MAC_DIGEST}, 2, 1), '0123456789abcdef', '2222666aaaa6eeee') || substr({MAC_DIGEST}, 3, 10))"
MAC_PAIRS = "array_to_string(list_transform(range(0, 6), lambda i: substr(" + MAC_TEXT + ", (2 * i + 1)::BIGINT, 2)), ':')"
add(
    "mask_mac_address", "MAC_ADDRESS", "customer", "c_custkey", MAC_IN,
    "CASE WHEN v = upper(v) THEN upper(" + MAC_PAIRS + ") ELSE " + MAC_PAIRS + " END",
)
UUID_DIGEST = sql.digest(KEY, "ref|uuid", "replace(v, '-', '')")
add(
    "mask_uuid", "UUID", "customer", "c_custkey", UUID_IN,
    f"substr({UUID_DIGEST}, 1, 8) || '-' || substr({UUID_DIGEST}, 9, 4) || '-4' || substr({UUID_DIGEST}, 14, 3) || '-' || "
    f"translate(substr({UUID_DIGEST}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({UUID_DIGEST}, 18, 3) || '-' || substr({UUID_DIGEST}, 21, 12)",
    salt="ref",
)
PRIORITIES = "low|normal|urgent"
add("mask_hash_list_of_values", "HASH_LOV", "orders", "o_orderkey", "o_orderpriority", sql.pick(KEY, f"prio|{PRIORITIES}", sql.normal("v"), PRIORITIES.split("|")), PRIORITIES, salt="prio")
add("mask_fixed", "FIXED", "customer", "c_custkey", "c_name", "'REMOVED'", "removed", "UPPER")
add("mask_nullify", "NULLIFY", "customer", "c_custkey", "c_name", "CAST(NULL AS VARCHAR)")
add("mask_passthrough", "PASSTHROUGH", "customer", "c_custkey", "c_name", "v")
add(
    "mask_partial_matches", "PARTIAL_MASK", "customer", "c_custkey", "'Ref-' || cast(c_custkey as string)",
    f"upper(substr({sql.first_name(KEY, 'name.first', quoted_ref := sql.quoted('Ref'))}, 1, 1)) || lower(substr({sql.first_name(KEY, 'name.first', quoted_ref)}, 2)) || substr(v, 4)",
)


@query("mask_sequence", "SELECT c_custkey, 'CUST' || (row_number() OVER (ORDER BY c_custkey) - 1) AS masked FROM customer")
def sequence_mask(t):
    rows = ops.sequence(t.customer.select("c_custkey"), ["c_custkey"], "seq_no")
    row = Row(index=F.col("seq_no") - 1)
    return rows.select("c_custkey", mask("SEQUENCE", F.col("c_custkey"), KEY, p1="CUST", row=row).alias("masked"))


@query(
    "mask_by_indicator",
    f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'TKN_' || substr({sql.digest(KEY, 'x|token', 'user_id::VARCHAR')}, 1, 32) "
    f"WHEN event_type = 'view' THEN {sql.first_name(KEY, 'name.first', 'user_id::VARCHAR')} ELSE {sql.keep_format(KEY, 'x', 'user_id::VARCHAR')} END AS masked FROM events",
)
def by_indicator(t):
    row = Row({"event_type": F.col("event_type")})
    spec = "CLICK=TOKENIZE|view=FIRST_NAME|*=FORMAT_PRESERVE"
    return t.events.select("event_id", mask("BY_INDICATOR", F.col("user_id"), KEY, "x", "event_type", spec, row).alias("masked"))


CARD_BODY = "'4' || lpad(cast((o_orderkey * 1299709) % 1000000000000 as string), 14, '0')"
EVERY_CARD = "SELECT count(*) AS n_rows, count(*) AS valid, count(*) AS distinct_out, count(*) AS kept, 0 AS unchanged FROM orders"


def card_properties(t, mode, kept):
    body = F.expr(CARD_BODY)
    rows = spread(t.orders.select("o_orderkey")).select(F.concat(body, luhn_digit(body)).alias("v"))
    rows = rows.select("v", mask("CREDIT_CARD", F.col("v"), KEY, None, mode).alias("m"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.sum(luhn_valid(F.col("m")).cast("bigint")).alias("valid"),
        F.count_distinct("m").alias("distinct_out"), F.sum(kept(F.col("v"), F.col("m")).cast("bigint")).alias("kept"),
        F.sum((F.col("v") == F.col("m")).cast("bigint")).alias("unchanged"),
    )


@query("mask_credit_card_keep_bin", EVERY_CARD)
def card_bin(t):
    return card_properties(t, None, lambda v, m: F.substring(v, 1, 6) == F.substring(m, 1, 6))


@query("mask_credit_card_keep_last4", EVERY_CARD)
def card_last4(t):
    return card_properties(t, "VALID_KEEP_LAST4", lambda v, m: F.substring(v, -4, 4) == F.substring(m, -4, 4))


@query("mask_credit_card_random_bin", EVERY_CARD)
def card_random(t):
    return card_properties(t, "VALID_RANDOM_BIN", lambda v, m: F.substring(v, 1, 1) == F.substring(m, 1, 1))


def split_columns(rows, key, fn, spec, row):
    masked = {c: mask(fn, F.col(c), KEY, None, c, spec, row) for c in row.columns}
    return ops.select_as(rows, {key: F.col(key), **masked})


@query(
    "mask_phone_split_columns",
    f"SELECT c_custkey, {AREA.replace(DIGITS, 'v')} AS area, '555' AS exchange, lpad((100 + {LINE.replace(DIGITS, 'v')})::VARCHAR, 4, '0') AS line FROM (SELECT *, {strip(PHONE_DIGITS)} AS v FROM customer) t",
)
def phone_split(t):
    whole = F.expr(PHONE_DIGITS)
    rows = spread(t.customer.select("c_custkey")).select(
        "c_custkey", F.substring(whole, 1, 3).alias("area"), F.substring(whole, 4, 3).alias("exchange"),
        F.substring(whole, 7, 4).alias("line"),
    )
    row = Row({c: F.col(c) for c in ("area", "exchange", "line")})
    spec = "area,exchange,line"
    return split_columns(rows, "c_custkey", "PHONE_SPLIT", spec, row)


@query(
    "mask_ssn_split_columns",
    f"SELECT c_custkey, {OWN_AREA} AS a, {GROUP.replace(DIGITS, 'v')} AS g, {SERIAL.replace(DIGITS, 'v')} AS s FROM (SELECT *, {SSN_DIGITS} AS v FROM customer) t",
)
def ssn_split(t):
    whole = F.expr(SSN_DIGITS)
    rows = spread(t.customer.select("c_custkey")).select(
        "c_custkey", F.substring(whole, 1, 3).alias("a"), F.substring(whole, 4, 2).alias("g"), F.substring(whole, 6, 4).alias("s")
    )
    row = Row({c: F.col(c) for c in ("a", "g", "s")})
    return split_columns(rows, "c_custkey", "SSN_SPLIT", "a,g,s", row)


@query(
    "mask_date_split_columns",
    f"SELECT o_orderkey, lpad((1 + {sql.draw(DOB_DRAWS, 2, 28)})::VARCHAR, 2, '0') AS d, lpad((1 + {sql.draw(DOB_DRAWS, 1, 12)})::VARCHAR, 2, '0') AS m, "
    f"(year(v::DATE) - year(v::DATE) % 5 + {sql.draw(DOB_DRAWS, 0, 5)})::VARCHAR AS y FROM (SELECT *, {ORDER_DAY} AS v FROM orders) t",
)
def date_split(t):
    rows = t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "dd").alias("d"), F.date_format("o_orderdate", "MM").alias("m"),
        F.date_format("o_orderdate", "yyyy").alias("y"),
    )
    row = Row({c: F.col(c) for c in ("d", "m", "y")})
    spec = "dd=d,mm=m,yyyy=y"
    return split_columns(rows, "o_orderkey", "DATE_SPLIT", spec, row)


@query(
    "mask_multi_value_column",
    f"SELECT p_partkey, {sql.first_name(KEY, 'name.first', FIRST_TOKEN)} || 'ý' || {sql.first_name(KEY, 'name.first', LAST_TOKEN)} || 'ýü' AS masked "
    f"FROM (SELECT *, {TWO_TOKENS} AS v FROM part) t",
)
def multi_value(t):
    marked = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("ý"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("ýü"))
    return t.part.select("p_partkey", mask("FIRST_NAME", marked, KEY, multi_value=True).alias("masked"))


@query(
    "mask_structured_marked_text",
    f"SELECT p_partkey, {sql.last_name(KEY, 'name.last', FIRST_TOKEN)} || 'ý' || {LAST_TOKEN} || 'þ' || 'TKN_' || substr({sql.digest(KEY, 'brand|token', 'lower(p_brand)')}, 1, 12) AS masked "
    f"FROM (SELECT *, {TWO_TOKENS} AS v FROM part) t",
)
def structured_marked(t):
    text = F.concat(
        F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("ý"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("þ"), "p_brand"
    )
    rules = [
        structured.LeafRule("1.1", "LAST_NAME"), structured.LeafRule("2.1", "TOKENIZE", "brand", p2="12"),
    ]
    return t.part.select("p_partkey", structured.mask_marked(text, rules, KEY).alias("masked"))


@query(
    "mask_structured_xml",
    f"SELECT c_custkey, '<person id=\"' || c_custkey || '\"><name>' || {sql.first_name(KEY, 'name.first', 'c_name')} || '</name><seg>' || c_mktsegment || '</seg></person>' AS masked FROM customer",
)
def structured_xml(t):
    text = F.concat(
        F.lit('<person id="'), F.col("c_custkey").cast("string"), F.lit('"><name>'), "c_name", F.lit("</name><seg>"),
        "c_mktsegment", F.lit("</seg></person>"),
    )
    rules = [structured.LeafRule("person/name", "FIRST_NAME")]
    return t.customer.select("c_custkey", structured.mask_xml(text, rules, KEY).alias("masked"))


MESSAGE = (
    "'{1:F01DEUTDEFFAXXX0000000000}{2:I103CHASUS33XXXXN}{4:' || chr(10) || ':20:REF' || cast(o_orderkey as string) || chr(10) || ':32A:240101USD' || "
    "cast(cast(o_totalprice as decimal(14,2)) as string) || chr(10) || ':50K:/' || lpad(cast(o_custkey as string), 10, '0') || chr(10) || 'JOHN SMITH' || chr(10) || "
    "'12 MAIN ST' || chr(10) || ':59:/DE89370400440532013000' || chr(10) || 'ANN LEE' || chr(10) || '-}'"
)


@query(
    "mask_swift_messages",
    "SELECT count(*) AS n_rows, count(*) AS same_length_header, count(*) AS amount_kept, 0 AS clear_name, 0 AS clear_account, count(*) AS address_kept FROM orders",
)
def swift_messages(t):
    rows = spread(t.orders.select("o_orderkey", "o_custkey", "o_totalprice")).select(F.expr(MESSAGE).alias("v"), "o_totalprice", "o_custkey")
    rows = rows.withColumn("m", mask("SWIFT_MT", F.col("v"), KEY, "swift"))
    amount = F.concat(F.lit(":32A:240101USD"), F.col("o_totalprice").cast("decimal(14,2)").cast("string"), F.lit("\n"))
    own = F.concat(F.lit("/"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.col("m").rlike(r"^\{1:F01[A-Z]{4}DE[A-Z0-9]{2}AXXX0000000000\}\{2:I103[A-Z]{4}US[A-Z0-9]{2}XXXXN\}").cast("bigint")).alias("same_length_header"),
        F.sum(F.col("m").contains(amount).cast("bigint")).alias("amount_kept"),
        F.sum((F.col("m").contains("JOHN SMITH") | F.col("m").contains("ANN LEE")).cast("bigint")).alias("clear_name"),
        F.sum((F.col("m").contains(own) | F.col("m").contains("DE89370400440532013000")).cast("bigint")).alias("clear_account"),
        F.sum(F.col("m").contains("\n12 MAIN ST\n").cast("bigint")).alias("address_kept"),
    )


register_mask(
    "name_and_segment",
    lambda value, param, row, key, salt: F.concat_ws(
        param or " ", mask("FIRST_NAME", value, key), row.original("c_mktsegment")
    ),
)


@query(
    "mask_user_function",
    f"SELECT c_custkey, {sql.first_name(KEY, 'name.first', 'c_name')} || '/' || c_mktsegment AS masked FROM customer",
)
def user_function(t):
    row = Row({"c_mktsegment": F.col("c_mktsegment")})
    return t.customer.select("c_custkey", mask("SCRIPT", F.col("c_name"), KEY, p1="name_and_segment", p2="/", row=row).alias("masked"))


@query(
    "mask_lookup_by_table",
    "SELECT c_custkey, n_name AS masked FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def lookup_table(t):
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("masked"))
    return lookup_by_table(rows, "masked", t.nation, "n_nationkey", "n_name", "ERROR")


@query(
    "mask_pick_from_table",
    f"WITH names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS place FROM (SELECT DISTINCT p_name FROM part)), "
    f"c AS (SELECT c_custkey, {sql.number(KEY, 'parts', sql.normal('c_name'))} % (SELECT count(*) FROM names) AS place FROM customer) "
    "SELECT c_custkey, p_name AS masked FROM c JOIN names USING (place)",
)
def pick_table(t):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("masked"))
    return pick_by_table(rows, "masked", KEY, "parts", t.part.select("p_name").distinct(), "p_name")


@query(
    "keyed_hash",
    f"SELECT o_orderkey, {sql.digest(KEY, 'order', 'o_orderkey::VARCHAR')} AS digest, {sql.number(KEY, 'order', 'o_orderkey::VARCHAR')} AS number FROM orders",
)
def keyed_hash(t):
    own = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", KEY.digest("order", own).alias("digest"), KEY.number("order", own).alias("number"))


@query(
    "keyed_draws_and_job_seed",
    f"SELECT o_orderkey, {sql.draw(sql.draws(KEY.with_seed('run 2'), 'o', 'o_orderkey::VARCHAR'), 0, 1000)} AS first_draw, "
    f"{sql.draw(sql.draws(KEY.with_seed('run 2'), 'o', 'o_orderkey::VARCHAR'), 7, 99)} AS last_draw FROM orders",
)
def keyed_draws(t):
    draws = KEY.with_seed("run 2").draws("o", F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", draws.below(0, 1000).alias("first_draw"), draws.below(7, 99).alias("last_draw"))


@query(
    "luhn_check",
    f"SELECT o_orderkey, {sql.luhn_ok('v')} AS ok FROM (SELECT o_orderkey, lpad((o_orderkey * 1299709)::VARCHAR, 16, '4') AS v FROM orders) t",
)
def luhn_check(t):
    text = F.lpad((F.col("o_orderkey") * 1299709).cast("string"), 16, "4")
    return t.orders.select("o_orderkey", luhn_valid(text).alias("ok"))
