"""Validation and compliance checks over whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from cloakwork.functions.masks import mask
from cloakwork.operators import checks as chk
from cloakwork.operators import discovery as dis
from cloakwork.operators.policy import Policy, Rule, apply_policy
from cloakwork.plans import sqltext as sql
from cloakwork.plans.keys import KEY
from cloakwork.plans.masking_queries import ACCOUNT, EMAIL_IN, PHONE, PHONE_DIGITS, SSN_DASHED, SSN_DIGITS, strip
from cloakwork.plans.registry import query
from cloakwork.session import spread

SECRET = "compliance-salt"


@query(
    "check_leak_of_source_values",
    "SELECT 'FAIL' AS severity, count(*) AS affected_rows FROM customer WHERE c_custkey % 10 = 0",
)
def leak(t):
    """A load that missed every tenth row still holds clear names there."""
    masked = t.customer.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.col("c_name")).otherwise(mask("FIRST_NAME", F.col("c_name"), KEY)))
    return chk.leak_check(t.customer, masked, "customer", "c_name").select("severity", "affected_rows")


INPUTS = {
    "EMAIL": EMAIL_IN, "SSN": SSN_DASHED, "IBAN": f"'DE89' || lpad(cast(c_custkey * 104729 as string), 18, '0')",
    "ABA_ROUTING": SSN_DIGITS, "UUID": "'6f9619ff-8b86-d011-b42d-' || lpad(cast(c_custkey as string), 12, '0')",
    "IP_ADDRESS": "'10.0.' || cast(c_custkey % 250 as string) || '.7'", "TOKENIZE": "c_name", "NUMERIC_NOISE": "cast(c_acctbal as string)",
    "MAC_ADDRESS": "'00:1a:2b:3c:4d:' || lpad(cast(c_custkey % 100 as string), 2, '0')", "SWIFT_BIC": "'DEUTDEFF'",
    "DATE_SHIFT": "'2020-01-' || lpad(cast(1 + c_custkey % 28 as string), 2, '0')", "NATIONAL_ID": SSN_DIGITS,
}
PARAMS = {"NATIONAL_ID": "CA"}


@query(
    "check_format_contracts",
    " UNION ALL ".join(f"SELECT '{f.lower()}' AS column_name, 'PASS' AS severity, 0 AS affected_rows FROM (SELECT count(*) FROM customer)" for f in INPUTS)
    + " UNION ALL SELECT 'broken', 'FAIL', count(*) FROM customer WHERE c_name NOT LIKE '%@%'",
)
def formats(t):
    rows = spread(t.customer.select("c_custkey", "c_name", "c_acctbal")).select("c_name", *[F.expr(v).alias(f.lower()) for f, v in INPUTS.items()], F.col("c_name").alias("broken"))
    rules = [Rule("c", f.lower(), f, p1=PARAMS.get(f)) for f in INPUTS]
    masked = apply_policy(rows, "c", Policy(KEY, rules))
    found = chk.format_checks(masked, "c", [*rules, Rule("c", "broken", "EMAIL")])
    return found.select("column_name", "severity", "affected_rows")


@query(
    "check_deliverable_domain",
    "SELECT 'WARN' AS severity, count(*) AS affected_rows FROM customer WHERE c_custkey % 7 = 0",
)
def deliverable(t):
    masked = F.when(F.col("c_custkey") % 7 == 0, F.expr(EMAIL_IN)).otherwise(mask("EMAIL", F.expr(EMAIL_IN), KEY))
    return chk.deliverable_domain(t.customer.select(masked.alias("email")), "customer", "email").select("severity", "affected_rows")


@query(
    "check_key_consistency",
    "SELECT 'TOKENIZE' AS function, o_custkey::VARCHAR AS source_value, 2 AS masks FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) GROUP BY 2",
)
def consistency(t):
    """Orders masked with another salt for every fifth customer: those keys have two masks."""
    key = lambda c, salt: mask("TOKENIZE", F.col(c), KEY, salt)
    customers = t.customer.select("c_custkey", F.col("c_custkey").alias("ref"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("ref"))
    masked_customers = t.customer.select("c_custkey", key("c_custkey", "cust").alias("ref"))
    masked_orders = t.orders.select(
        "o_orderkey", F.when(F.col("o_custkey") % 5 == 0, key("o_custkey", "other")).otherwise(key("o_custkey", "cust")).alias("ref")
    )
    found = chk.key_witness(
        [("TOKENIZE", customers, masked_customers, ["c_custkey"], "ref"), ("TOKENIZE", orders, masked_orders, ["o_orderkey"], "ref")]
    )
    return found.select("function", "source_value", "masks")


@query(
    "check_result_roll_up",
    "SELECT 'FAIL' AS result, 1 AS fails, 1 AS warns, 3 AS findings FROM (SELECT count(*) FROM customer)",
)
def rolled(t):
    masked = t.customer.select(mask("EMAIL", F.expr(EMAIL_IN), KEY).alias("email"), "c_name", F.expr(EMAIL_IN).alias("raw"))
    found = (
        chk.leak_check(t.customer, masked, "customer", "c_name")
        .union(chk.deliverable_domain(masked, "customer", "raw")).union(chk.deliverable_domain(masked, "customer", "email"))
    )
    return chk.roll_up(found)


@query(
    "check_uncovered_columns",
    "SELECT 'FAIL' AS severity, 'customer' AS table_name, 'c_name' AS column_name, 'FULL_NAME' AS pii_type, count(*) AS affected_rows FROM customer "
    "UNION ALL SELECT 'FAIL', 'pages', 'url', 'URL', count(*) FROM pages",
)
def uncovered(t):
    found = dis.discover({"customer": t.customer, "supplier": t.supplier, "pages": t.pages.select("page_id", "url")})
    return chk.uncovered(found, [Rule("supplier", "s_name", "COMPANY")]).select(
        "severity", "table_name", "column_name", "pii_type", "affected_rows"
    )


@query(
    "check_leak_by_hash",
    f"WITH b AS (SELECT DISTINCT upper(regexp_replace(trim(text), '[\\s\\-()./]', '', 'g')) AS v FROM benchmark), "
    "d AS (SELECT text, upper(regexp_replace(trim(text), '[\\s\\-()./]', '', 'g')) AS v FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) "
    "SELECT 'text' AS column_name, count(*) AS affected_rows, count(DISTINCT v) AS leaked_values, "
    f"substr(min(sha256(unhex('{(chk.HASH_CONTEXT + SECRET.encode() + bytes(1)).hex()}') || encode(v))), 1, 16) AS witness FROM d WHERE v IN (SELECT v FROM b) AND v <> ''",
)
def hash_leak(t):
    target = t.documents.select("text").union(t.benchmark.select("text"))
    return chk.hash_leaks(t.benchmark, ["text"], target, ["text"], SECRET)


REAL_INPUTS = {"ssn": ("SSN", SSN_DASHED), "phone": ("PHONE", PHONE), "email": ("EMAIL", EMAIL_IN), "aba": ("ROUTING", SSN_DIGITS), "acct": ("IBAN", ACCOUNT)}
DIG = strip(PHONE_DIGITS)
ABA_SUM = " + ".join(f"substr({SSN_DIGITS}, {i + 1}, 1)::INT * {w}" for i, w in enumerate([3, 7, 1, 3, 7, 1, 3, 7, 1]))


@query(
    "check_real_world_validity",
    f"SELECT 'ssn' AS column_name, 'SSN' AS pii_type, count(*) FILTER (substr({SSN_DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({SSN_DIGITS}, 1, 1) <> '9' AND substr({SSN_DIGITS}, 4, 2) <> '00' AND substr({SSN_DIGITS}, 6, 4) <> '0000') AS real_rows FROM customer "
    f"UNION ALL SELECT 'phone', 'PHONE', count(*) FILTER (regexp_matches({DIG}, '^[2-9]\\d\\d[2-9]\\d{{6}}$') AND substr({DIG}, 1, 3) <> '555' AND substr({DIG}, 4, 3) <> '555') FROM customer "
    "UNION ALL SELECT 'email', 'EMAIL', count(*) FROM customer "
    f"UNION ALL SELECT 'aba', 'ROUTING', count(*) FILTER (({ABA_SUM}) % 10 = 0) FROM customer UNION ALL SELECT 'acct', 'IBAN', 0 FROM (SELECT count(*) FROM customer)",
)
def real_values(t):
    rows = spread(t.customer.select("c_custkey")).select(*[F.expr(v).alias(c) for c, (_, v) in REAL_INPUTS.items()])
    return chk.validity_leaks(rows, "customer", {c: k for c, (k, _) in REAL_INPUTS.items()}).drop("table_name")


@query(
    "check_masked_values_are_not_real",
    "SELECT column_name, pii_type, 0 AS real_rows FROM (VALUES ('phone', 'PHONE'), ('email', 'EMAIL'), ('ssn', 'SSN')) v(column_name, pii_type) WHERE (SELECT count(*) FROM customer) > 0",
)
def masked_not_real(t):
    rows = spread(t.customer.select("c_custkey")).select(
        mask("PHONE", F.expr(PHONE), KEY).alias("phone"), mask("EMAIL", F.expr(EMAIL_IN), KEY).alias("email"),
        mask("SSN", F.expr(SSN_DASHED), KEY, p1="KEEP_LAST4").alias("ssn"),
    )
    return chk.validity_leaks(rows, "customer", {"phone": "PHONE", "email": "EMAIL", "ssn": "SSN"}).drop("table_name")


VARIETY = ["o_custkey", "o_orderstatus", "o_orderkey", "o_clerk"]
COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS total, count(DISTINCT {c}) AS distinct_values FROM o" for c in VARIETY)


@query(
    "check_cardinality_collapse",
    f"WITH o AS (SELECT *, 'X' AS o_clerk FROM orders), c AS ({COUNTS}) SELECT column_name, CASE WHEN distinct_values <= 1 OR distinct_values / total < 0.1 THEN 'FAIL' ELSE 'WARN' END AS severity, "
    "total, distinct_values, round(distinct_values / total, 4) AS ratio FROM c WHERE total >= 50 AND (distinct_values <= 1 OR distinct_values / total < 0.5)",
)
def collapse(t):
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.lit("X").alias("o_clerk"))
    return chk.cardinality(dis.value_counts(rows, VARIETY))


@query(
    "check_key_uniqueness",
    "SELECT count(*) AS total, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def uniqueness(t):
    return chk.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "check_subject_erasure",
    "SELECT 'customer' AS table_name, 'c_name' AS column_name, count(*) AS affected_rows FROM customer WHERE c_name = 'Customer#000000042' "
    "UNION ALL SELECT 'copy', 'holder', count(*) FROM customer WHERE c_name = 'Customer#000000042'",
)
def erasure(t):
    copy = t.customer.select(F.concat(F.lit(" customer#"), F.substr("c_name", F.lit(10), F.lit(3)), F.lit("-"), F.substr("c_name", F.lit(13)), F.lit(" ")).alias("holder"))
    return chk.erasure_search(
        {"customer": (t.customer, ["c_name", "c_mktsegment"]), "copy": (copy, ["holder"]), "supplier": (t.supplier, ["s_name"])}, "Customer#000000042"
    )


@query(
    "check_crosswalk_reversibility",
    "SELECT c_name AS original FROM customer WHERE c_nationkey = 3",
)
def crosswalk(t):
    """Rows of a stored look-up that would give the customers of one nation away."""
    stored = t.customer.select(F.col("c_name").alias("original"), mask("FIRST_NAME", F.col("c_name"), KEY).alias("masked"))
    return chk.reversible_rows(stored, "original", t.customer.where("c_nationkey = 3"), "c_name").select("original")


@query(
    "check_waivers",
    "SELECT 'WARN' AS severity, 'customer' AS table_name, 'c_name' AS column_name, 'W1' AS waiver_id FROM (SELECT count(*) FROM customer) "
    "UNION ALL SELECT 'FAIL', 'pages', 'url', NULL UNION ALL SELECT 'WARN', 'supplier', 's_name', 'W4'",
)
def waivers(t):
    found = dis.discover({"customer": t.customer, "supplier": t.supplier, "pages": t.pages.select("page_id", "url")})
    open_columns = chk.uncovered(found, [])
    rows = [
        ("W1", "customer.c_name", "FULL_NAME", "APPROVED", dt.date(2030, 1, 1)), ("W2", "pages.url", "URL", "APPROVED", dt.date(2020, 1, 1)),
        ("W3", "pages", "EMAIL", "APPROVED", dt.date(2030, 1, 1)), ("W4", "supplier", None, "APPROVED", dt.date(2030, 1, 1)),
    ]
    waivers = t.spark.createDataFrame(rows, "waiver_id string, scope string, pii_type string, status string, expires_on date")
    return chk.apply_waivers(open_columns, waivers, dt.date(2024, 6, 1)).select("severity", "table_name", "column_name", "waiver_id")


@query(
    "check_posture_roll_up",
    "SELECT event_type AS check_name, count(*) AS findings, count(*) FILTER (value > 20) AS fail, count(*) FILTER (value > 10 AND value <= 20) AS warn, "
    "count(*) FILTER (value <= 10) AS pass, sum(user_id)::BIGINT AS affected_rows FROM events GROUP BY 1",
)
def posture(t):
    history = t.events.select(
        F.col("event_type").alias("check_name"), F.when(F.col("value") > 20, "FAIL").when(F.col("value") > 10, "WARN").otherwise("PASS").alias("severity"),
        F.col("user_id").alias("affected_rows"),
    )
    return chk.posture(history)


SEGMENT = 50


def chained(rows):
    """Events with a real hash chain in segments of fifty; each segment starts with an anchor."""
    event = F.struct(*rows.columns)
    groups = rows.groupBy(F.floor(F.col("seq") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(event)).alias("events"))

    def step(done, e):
        previous = F.when(F.size(done) > 0, F.element_at(done, -1)["hash"]).otherwise("")
        own = chk.event_hash(previous, [e["seq"], e["event_type"], e["user_id"]])
        return F.concat(done, F.array(F.struct(e["seq"].alias("seq"), e["event_type"].alias("event_type"), e["user_id"].alias("user_id"), previous.alias("prev_hash"), own.alias("hash"))))

    kind = "array<struct<seq:bigint,event_type:string,user_id:bigint,prev_hash:string,hash:string>>"
    chain = F.aggregate("events", F.array().cast(kind), lambda done, e: F.when(F.size(done) > 0, step(done, e)).otherwise(step(F.array().cast(kind), e)))
    return groups.select(F.explode(chain).alias("e")).select("e.*")


@query(
    "check_audit_chain",
    "SELECT event_id AS seq, CASE WHEN event_id % 997 = 5 THEN 'CONTENT_MISMATCH' ELSE 'LINK_BREAK' END AS reason FROM events "
    "WHERE event_id % 997 = 5 OR event_id % 1009 = 7 OR (event_id % 1009 = 8 AND event_id % 50 <> 0)",
)
def audit(t):
    """Planted breaks: changed content, and a wrong link with a fresh hash (which also breaks the link after it)."""
    fields = ["seq", "event_type", "user_id"]
    chain = chained(t.events.select(F.col("event_id").alias("seq"), "event_type", "user_id"))
    moved = F.col("seq") % 1009 == 7
    chain = chain.withColumn("prev_hash", F.when(moved, "tampered").otherwise(F.col("prev_hash")))
    chain = chain.withColumn("hash", F.when(moved, chk.event_hash(F.col("prev_hash"), [F.col(c) for c in fields])).otherwise(F.col("hash")))
    chain = chain.withColumn("user_id", F.when(F.col("seq") % 997 == 5, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return chk.verify_chain(chain, "seq", fields, anchor=f"seq % {SEGMENT} = 0")


@query(
    "check_reconciliation",
    "SELECT count(*) AS source_rows, count(*) FILTER (o_orderkey % 100 <> 0) AS target_rows, false AS same_keys, "
    "CAST(sum(CASE WHEN o_orderkey % 100 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS o_totalprice_difference FROM orders",
)
def reconciliation(t):
    return chk.reconcile(t.orders, t.orders.where("o_orderkey % 100 <> 0"), "o_orderkey", ["o_totalprice"])


@query(
    "check_duplicate_key_diagnostic",
    "WITH m AS (SELECT c_custkey, c_name AS original, c_mktsegment || (c_custkey % 3) AS masked FROM customer), "
    "k AS (SELECT masked, count(DISTINCT original) AS originals, count(*) AS rows FROM m GROUP BY 1 HAVING count(DISTINCT original) > 1) "
    "SELECT masked, c_custkey, original, originals, rows FROM m JOIN k USING (masked)",
)
def diagnostic(t):
    target = t.customer.select("c_custkey", F.concat("c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("c_name"))
    return chk.clash_report(t.customer, target, ["c_custkey"], "c_name")
