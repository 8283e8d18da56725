"""Discovery and profiling over whole tables."""

from pyspark.sql import functions as F

from cloakwork.functions.keyed import iban_valid, luhn_valid
from cloakwork.operators import discovery as dis
from cloakwork.plans.registry import query
from cloakwork.session import spread

CONTACT = (
    "SELECT c_custkey AS cust_no, 'user' || c_custkey || '@corp.com' AS contact, c_name AS full_name, "
    "'(212) 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS phone, c_acctbal AS salary, "
    "CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE 'https://host.example/' || c_custkey END AS site, "
    "'user' || c_custkey || '@corp.com' AS phone_backup FROM {customer}"
)


def contacts(t):
    t.customer.createOrReplaceTempView("customer_for_discovery")
    return t.spark.sql(CONTACT.format(customer="customer_for_discovery"))


@query(
    "discover_personal_data",
    f"WITH c AS ({CONTACT.format(customer='customer')}), n AS (SELECT count(*) AS n FROM c) "
    "SELECT * FROM (VALUES ('contact', 'EMAIL', 0.75, 'EMAIL'), ('full_name', 'FULL_NAME', 0.6, 'FULL_NAME'), "
    "('phone', 'PHONE', 0.99, 'PHONE'), ('salary', 'EMPLOYMENT_DATA', 0.6, 'FORMAT_PRESERVE'), ('phone_backup', 'EMAIL', 0.7, 'EMAIL')) "
    "f(column_name, pii_type, confidence, suggested_function) UNION ALL "
    "SELECT 'site', 'URL', round(0.35 + 0.4 * count(*) FILTER (site LIKE 'https%') / (SELECT n FROM n), 4), 'TOKENIZE' FROM c",
)
def discover(t):
    found = dis.findings(dis.column_scores({"contacts": contacts(t)}))
    return found.select("column_name", "pii_type", "confidence", "suggested_function")


@query(
    "discover_value_hits",
    "SELECT 'url' AS column_name, 'URL' AS kind, count(*) FILTER (regexp_matches(trim(url), '^(?i:https?://|www\\.)[^\\s]+$')) AS hits FROM pages",
)
def value_hits(t):
    scores = dis.column_scores({"pages": t.pages.select("url")})
    return scores.select("column_name", F.explode("hits").alias("h")).select("column_name", "h.kind", "h.hits").where("hits > 0 AND kind = 'URL'")


NAMED = [("customer", "c_name", "FULL_NAME", "FULL_NAME"), ("supplier", "s_name", "FULL_NAME", "FULL_NAME"), ("part", "p_name", "FULL_NAME", "FULL_NAME"), ("events", "user_id", "USERNAME", "FORMAT_PRESERVE")]


@query(
    "discover_all_tables",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS pii_type, 0.6 AS confidence, '{fn}' AS suggested_function, 0 AS value_hits FROM (SELECT count(*) FROM {table})"
        for table, column, kind, fn in NAMED
    )
    + " UNION ALL SELECT 'pages', 'url', 'URL', round(least(0.99, 0.6 + 0.4 * hits / n), 4), 'TOKENIZE', hits FROM (SELECT count(*) AS n, count(*) FILTER (regexp_matches(trim(url), '^(?i:https?://|www\\.)[^\\s]+$')) AS hits FROM pages)",
)
def discover_all(t):
    """Findings over every given table, one scan each."""
    names = "customer supplier part orders events documents pages conversations".split()
    return dis.discover({n: spread(getattr(t, n)) for n in names}).select(
        "table_name", "column_name", "pii_type", "confidence", "suggested_function", "value_hits"
    )


NUMBERS = "lpad(CAST(o_orderkey * 1299709 AS STRING), 16, '4')"


@query(
    "discover_strong_validators",
    f"SELECT o_orderkey, list_sum(list_transform(string_split(reverse({NUMBERS}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN (c::INT * 2) // 10 + (c::INT * 2) % 10 ELSE c::INT END)) % 10 = 0 AS card, "
    f"(lpad(o_orderkey::VARCHAR, 18, '0') || '1314' || lpad((o_orderkey % 97)::VARCHAR, 2, '0'))::HUGEINT % 97 = 1 AS iban FROM orders",
)
def validators(t):
    iban = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"))
    return t.orders.select(
        "o_orderkey", luhn_valid(F.expr(NUMBERS)).alias("card"), iban_valid(iban, dis.IBAN_COUNTRIES).alias("iban")
    )


@query(
    "discover_structured_leaves",
    "SELECT '1.2' AS path, 'EMAIL' AS pii_type, count(*) AS leaves, 1.0 AS share FROM customer",
)
def leaves(t):
    marked = F.concat("c_name", F.lit("ý"), F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@corp.com"), F.lit("þ"), "c_mktsegment")
    found = dis.leaf_findings(t.customer.select(marked.alias("doc")), "customer", "doc")
    return found.where("pii_type = 'EMAIL'").select("path", "pii_type", "leaves", "share")


@query(
    "discover_structured_xml_leaves",
    "SELECT 'p/ip' AS path, 'IP_ADDRESS' AS pii_type, count(*) AS leaves, 1.0 AS share FROM customer",
)
def xml_leaves(t):
    doc = F.concat(F.lit("<p><ip>10.1.2."), (F.col("c_custkey") % 200).cast("string"), F.lit("</ip><n>"), "c_name", F.lit("</n></p>"))
    found = dis.leaf_findings(t.customer.select(doc.alias("doc")), "customer", "doc", "xml")
    return found.where("path = 'p/ip' AND pii_type = 'IP_ADDRESS'").select("path", "pii_type", "leaves", "share")


@query(
    "discover_redacted_sample",
    "SELECT c_custkey, left(c_name, 1) || '***' || right(c_name, 2) AS name_sample, left(c_mktsegment, 1) || '***' || right(c_mktsegment, 2) AS segment_sample FROM customer",
)
def redacted(t):
    return t.customer.select(
        "c_custkey", dis.redacted_sample(F.col("c_name")).alias("name_sample"),
        dis.redacted_sample(F.col("c_mktsegment")).alias("segment_sample"),
    )


COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "profile_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, "
        f"round((count(*) - count({c})) / count(*), 3) AS null_rate FROM o"
        for c in COLUMNS
    ).replace("FROM o", "FROM (SELECT o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderpriority FROM orders)"),
)
def profile(t):
    rows = t.orders.select("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice", "o_orderpriority")
    return dis.column_profile(dis.value_counts(rows))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "profile_numeric_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 4) AS spread FROM lineitem" for c in NUMERIC
    ),
)
def stats(t):
    return dis.numeric_stats(t.lineitem.select(*NUMERIC))


@query(
    "profile_top_values",
    " UNION ALL ".join(
        f"(SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS place FROM part GROUP BY {c} QUALIFY place <= 25)"
        for c in ("p_brand", "p_type", "p_size")
    ),
)
def tops(t):
    return dis.top_values(dis.value_counts(t.part, ["p_brand", "p_type", "p_size"]))


@query(
    "profile_date_range",
    "SELECT 'l_shipdate' AS column_name, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last FROM lineitem",
)
def dates(t):
    return dis.date_ranges(t.lineitem.select("l_shipdate"))


@query(
    "profile_percent_true",
    "SELECT 'returned' AS column_name, CAST(round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) * 100) AS INT) AS percent_true FROM lineitem",
)
def flags(t):
    return dis.percent_true(t.lineitem.select((F.col("l_returnflag") == "R").alias("returned")), ["returned"])


@query(
    "profile_recommend_generators",
    "SELECT * FROM (VALUES ('c_custkey', 'SEQUENCE', NULL, NULL), ('c_name', 'PADDED_SEQUENCE', 'PII_NAME', 'suppressed'), ('c_nationkey', 'WEIGHTED', NULL, 'used'), "
    "('c_acctbal', CASE WHEN (SELECT count(DISTINCT c_acctbal) = count(*) FROM customer) THEN 'SEQUENCE' ELSE 'NORMAL_DECIMAL' END, NULL, NULL), ('c_mktsegment', 'WEIGHTED', NULL, 'used')) f(column_name, generator, sensitivity, source_values) WHERE (SELECT count(*) FROM customer) > 0",
)
def recommend(t):
    return dis.recommend(t.customer, ["c_custkey"]).select("column_name", "generator", "sensitivity", "source_values")


@query(
    "profile_sensitive_suppression",
    "SELECT 'customer_name' AS column_name, 'FULL_NAME' AS generator, '' AS param1, 'suppressed' AS source_values FROM (SELECT count(*) FROM customer) UNION ALL "
    "SELECT 'status', 'WEIGHTED', string_agg(c_mktsegment || ':' || n, '|' ORDER BY n DESC, c_mktsegment), 'used' FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)",
)
def suppression(t):
    """A name column with few values still gets a generator, never its own values."""
    rows = t.customer.select(F.concat(F.lit("N"), (F.col("c_custkey") % 5).cast("string")).alias("customer_name"), F.col("c_mktsegment").alias("status"))
    return dis.recommend(rows).select("column_name", "generator", "param1", "source_values")


@query(
    "profile_name_sensitivity",
    "SELECT * FROM (VALUES ('ssn_code', 'SSN', 'PII_TAX_ID', 'suppressed'), ('card_type', 'WEIGHTED', NULL, 'used'), ('account_id', 'PADDED_SEQUENCE', 'TECHNICAL_IDENTIFIER', 'suppressed'), "
    "('row_pk', 'SEQUENCE', 'TECHNICAL_IDENTIFIER', 'suppressed'), ('customer_tax_id', 'ALPHANUMERIC', 'PII_TAX_ID', 'suppressed'), "
    "('father_name', 'MALE_FIRST_NAME', 'PII_NAME', 'suppressed'), ('female_first_name', 'FEMALE_FIRST_NAME', 'PII_NAME', 'suppressed'), "
    "('account', 'ACCOUNT_NUMBER', 'FINANCIAL_ACCOUNT', 'suppressed')) f(column_name, generator, sensitivity, source_values) WHERE (SELECT count(*) FROM customer) > 0",
)
def name_sensitivity(t):
    """Tax numbers are sensitive whatever else their name says; identifiers of the source never stay; types may."""
    few = F.col("c_mktsegment")
    texts = ("ssn_code", "card_type", "account_id", "account", "customer_tax_id", "father_name", "female_first_name")
    rows = t.customer.select(*[few.alias(c) for c in texts], (F.col("c_custkey") % 7).alias("row_pk"))
    return dis.recommend(rows).select("column_name", "generator", "sensitivity", "source_values")


@query(
    "discover_rescan_merge",
    "SELECT * FROM (VALUES ('contact', 'CUSTOM', 'APPROVED'), ('full_name', 'FULL_NAME', 'SUGGESTED'), ('phone', 'PHONE', 'SUGGESTED'), ('salary', 'EMPLOYMENT_DATA', 'SUGGESTED'), "
    "('site', 'URL', 'SUGGESTED'), ('phone_backup', 'EMAIL', 'SUGGESTED'), ('gone_reviewed', 'SSN', 'REJECTED')) f(column_name, pii_type, status) WHERE (SELECT count(*) FROM customer) > 0",
)
def rescan(t):
    fresh = dis.findings(dis.column_scores({"contacts": contacts(t)}))
    old = t.spark.createDataFrame(
        [
            ("contacts", "contact", "CUSTOM", 0.9, "TOKENIZE", "APPROVED"), ("contacts", "full_name", "EMAIL", 0.5, "EMAIL", "SUGGESTED"),
            ("contacts", "gone_reviewed", "SSN", 0.8, "SSN", "REJECTED"), ("contacts", "gone_stale", "SSN", 0.8, "SSN", "SUGGESTED"),
        ],
        "table_name string, column_name string, pii_type string, confidence double, suggested_function string, status string",
    )
    return dis.rescan(old, fresh).select("column_name", "pii_type", "status")
