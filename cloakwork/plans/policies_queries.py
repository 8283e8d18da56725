"""Masking jobs: policies on tables, overrides, conditions, key consistency, free text."""

from pyspark.sql import functions as F

from cloakwork.functions import freetext, scanner, structured
from cloakwork.functions.masks import PRIORITY  # noqa: F401
from cloakwork.operators import loads
from cloakwork.operators import policy as pol
from cloakwork.operators import subset as sub
from cloakwork.operators.policy import Clause, Override, Policy, Rule
from cloakwork.plans import sqltext as sql
from cloakwork.plans.keys import EDGES, KEY, PRIMARY_KEYS
from cloakwork.plans.registry import query
from cloakwork.session import scratch_path, spread

GIVEN = sql.first_name(KEY, "name.first", "c_name")


@query(
    "policy_staged_rules",
    f"SELECT c_custkey, {GIVEN} AS first_nm, {sql.last_name(KEY, 'name.last', 'c_name')} AS last_nm, "
    f"{GIVEN} || ' ' || {sql.last_name(KEY, 'name.last', 'c_name')} AS whole, c_mktsegment FROM customer",
)
def staged(t):
    """The composed name uses the masked first and last name of its row."""
    rows = t.customer.select(
        "c_custkey", F.col("c_name").alias("first_nm"), F.col("c_name").alias("last_nm"), F.col("c_mktsegment").alias("whole"),
        "c_mktsegment",
    )
    rules = [Rule("c", "whole", "FULL_NAME"), Rule("c", "first_nm", "FIRST_NAME"), Rule("c", "last_nm", "LAST_NAME")]
    return pol.apply_policy(rows, "c", Policy(KEY, rules))


SHARED_KEY = "ri:customer.c_custkey"
TOKEN = "'TKN_' || substr({d}, 1, 16)"


def token(value: str) -> str:
    return TOKEN.format(d=sql.digest(KEY, f"{SHARED_KEY}|token", value))


@query(
    "policy_key_salt_join",
    f"SELECT {token('c_custkey::VARCHAR')} AS customer_token, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def key_salt_join(t):
    """Masked keys of two tables still join, because linked columns share one salt."""
    tables = {
        "customer": t.customer.select(F.col("c_custkey").cast("string").alias("c_custkey")),
        "orders": t.orders.select(F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey")),
    }
    rules = [Rule("customer", "c_custkey", "TOKENIZE", p2="16"), Rule("orders", "o_custkey", "TOKENIZE", p2="16")]
    edges = [e for e in EDGES if e.child == "orders"]
    out = pol.mask_tables(tables, Policy(KEY, rules), edges)
    joined = out["customer"].join(out["orders"], F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy(F.col("c_custkey").alias("customer_token")).agg(F.count("*").alias("orders"))


@query(
    "policy_column_overrides",
    f"SELECT c_custkey, {GIVEN} AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, 'HIDDEN' AS c_mktsegment FROM customer",
)
def overrides(t):
    policy = Policy(
        KEY, [Rule("customer", "c_name", "FIRST_NAME"), Rule("customer", "c_acctbal", "NUMERIC_NOISE")],
        [
            Override("customer", "c_acctbal", "NULL_OUT"), Override("customer", "c_mktsegment", "LITERAL", "HIDDEN"),
            Override("customer", "c_nationkey", "SUPPRESS"), Override("customer", "c_name", "USE_POLICY"),
        ],
    )
    return pol.apply_policy(t.customer, "customer", policy)


@query(
    "policy_conditions_all_and_any",
    f"SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 THEN {GIVEN} ELSE c_name END AS c_name, "
    "CASE WHEN c_nationkey < 3 OR c_mktsegment LIKE 'FURN%' THEN repeat('*', length(c_mktsegment)) ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def conditions(t):
    rules = [
        Rule(
            "customer", "c_name", "FIRST_NAME",
            clauses=(Clause("c_mktsegment", "IN", "building, machinery"), Clause("c_acctbal", "GTE", "1000")),
        ),
        Rule(
            "customer", "c_mktsegment", "REDACT", logic="ANY",
            clauses=(Clause("c_nationkey", "LT", "3"), Clause("c_mktsegment", "STARTS_WITH", "furn")),
        ),
    ]
    return pol.apply_policy(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"), "customer", Policy(KEY, rules)).select(
        "c_custkey", "c_name", "c_mktsegment"
    )


@query(
    "policy_condition_by_joined_table",
    f"SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN repeat('*', length(o_orderpriority)) ELSE o_orderpriority END AS o_orderpriority "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def joined_condition(t):
    clause = Clause("c_mktsegment", "EQ", "Building", "customer", "o_custkey", "c_custkey")
    rules = [Rule("orders", "o_orderpriority", "REDACT", clauses=(clause,))]
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return pol.apply_policy(rows, "orders", Policy(KEY, rules), {"customer": t.customer}).drop("o_custkey")


@query(
    "policy_condition_expression",
    f"SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_nationkey = 4 THEN {sql.first_name(KEY, 'name.first', 's_name')} ELSE s_name END AS s_name FROM supplier",
)
def condition_expression(t):
    rules = [Rule("supplier", "s_name", "FIRST_NAME", condition="s_acctbal < 0 OR s_nationkey = 4")]
    return pol.apply_policy(t.supplier, "supplier", Policy(KEY, rules)).select("s_suppkey", "s_name")


ROW_TEXT = "'{l_commit=' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') || ', o_orderdate=' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ', o_orderkey=' || o_orderkey || '}'"
ROW_DAYS = f"(5 + {sql.number(KEY, 'row|dshift', ROW_TEXT)} % 16)"


@query(
    "policy_shared_date_shift",
    f"SELECT o_orderkey, o_orderdate + to_days({ROW_DAYS}::INT) AS o_orderdate, o_orderdate + INTERVAL 3 DAY + to_days({ROW_DAYS}::INT) AS l_commit FROM orders",
)
def shared_shift(t):
    """Two shifted dates of a row move together, so their interval stays."""
    rows = spread(t.orders).select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 3 days")).alias("l_commit"))
    rules = [Rule("o", "o_orderdate", "DATE_SHIFT", p1="5:60"), Rule("o", "l_commit", "DATE_SHIFT", p1="-10:20")]
    return pol.apply_policy(rows, "o", Policy(KEY, rules))


@query(
    "policy_mask_copy_tables",
    "SELECT 'customer' AS table_name, count(*) AS n_rows, 0 AS clear_rows FROM customer UNION ALL SELECT 'orders', count(*), 0 FROM orders UNION ALL SELECT 'supplier', count(*), 0 FROM supplier",
)
def mask_copy(t):
    """Masked copies written per table in load order, read back and counted."""
    rules = [
        Rule("customer", "c_name", "FULL_NAME"), Rule("supplier", "s_name", "COMPANY"),
        Rule("orders", "o_orderpriority", "SECURE_LOOKUP", p1="low|mid|high"),
    ]
    tables = {n: getattr(t, n) for n in ("customer", "supplier", "orders")}
    masked = pol.mask_tables(tables, Policy(KEY, rules), [e for e in EDGES if e.child in tables and e.parent in tables])
    clear = {"customer": "c_name LIKE 'Customer#%'", "supplier": "s_name LIKE 'Supplier#%'", "orders": "o_orderpriority LIKE '%-%'"}
    parts = []
    for name, frame in masked.items():
        path = scratch_path(t.spark, f"copy-{name}")
        loads.replace(frame, path)
        parts.append(
            t.spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.count_if(F.expr(clear[name])).alias("clear_rows"))
            .select(F.lit(name).alias("table_name"), "n_rows", "clear_rows")
        )
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "policy_in_place_subset_trim",
    f"SELECT o_orderkey, {sql.pick(KEY, 'orders.o_orderpriority|secure-lookup', sql.normal('o_orderpriority'), ['low', 'mid'])} AS o_orderpriority "
    "FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def in_place_trim(t):
    """Target copy trimmed to the kept keys, then masked in the same place."""
    path = scratch_path(t.spark, "in-place")
    loads.replace(t.orders, path)
    keep = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rules = [Rule("orders", "o_orderpriority", "SECURE_LOOKUP", p1="low|mid")]

    def change(rows):
        kept = rows.join(keep, "o_custkey", "left_semi")
        return pol.apply_policy(kept, "orders", Policy(KEY, rules))

    loads.rewrite_in_place(t.spark, path, change)
    return t.spark.read.parquet(path).select("o_orderkey", "o_orderpriority")


@query(
    "policy_value_list",
    "SELECT c_mktsegment AS entry, count(*) AS weight FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
)
def value_list(t):
    return pol.value_list(t.customer, "c_mktsegment")


@query(
    "policy_mixed_sources",
    f"SELECT 'customer' AS origin, {GIVEN} AS name FROM customer UNION ALL SELECT 'supplier', {sql.pick(KEY, 'company|companies.txt', sql.normal('s_name'), __import__('cloakwork.functions.wordlists', fromlist=['COMPANIES']).COMPANIES)} FROM supplier",
)
def mixed_sources(t):
    default = Policy(KEY, [Rule("customer", "c_name", "FIRST_NAME"), Rule("supplier", "s_name", "FIRST_NAME")])
    own = Policy(KEY, [Rule("supplier", "s_name", "COMPANY")])
    out = pol.mask_sources({"customer": (lambda: t.customer, None), "supplier": (lambda: t.supplier, own)}, default)
    return (
        out["customer"].select(F.lit("customer").alias("origin"), F.col("c_name").alias("name"))
        .union(out["supplier"].select(F.lit("supplier"), "s_name"))
    )


@query(
    "policy_numbers_keep_type_and_digits",
    "SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(DISTINCT o_orderkey) FROM orders) AS order_keys, "
    "(SELECT count(DISTINCT o_totalprice::DECIMAL(12, 2)) FROM orders) AS prices, 0 AS other_digits, "
    "(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS joined",
)
def numbers_keep_digits(t):
    """Keys as int, smallint and bigint, prices as decimal: masked one-to-one inside their types, and keys of other width still join."""
    orders = spread(t.orders.select("o_orderkey", "o_custkey", "o_totalprice")).select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), F.col("o_orderkey").cast("int").alias("was"),
    )
    customer = spread(t.customer.select(F.col("c_custkey").cast("int").alias("c_custkey")))
    rules = [
        Rule("orders", "o_orderkey", "FORMAT_PRESERVE"), Rule("orders", "o_custkey", "FORMAT_PRESERVE"),
        Rule("orders", "o_totalprice", "CHARACTER_MAP"), Rule("customer", "c_custkey", "FORMAT_PRESERVE"),
    ]
    out = pol.mask_tables({"orders": orders, "customer": customer}, Policy(KEY, rules), [e for e in EDGES if e.child == "orders"])
    other = F.char_length(F.col("o_orderkey").cast("string")) != F.char_length(F.col("was").cast("string"))
    seen = out["orders"].agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("order_keys"), F.count_distinct("o_totalprice").alias("prices"),
        F.count_if(other).cast("int").alias("other_digits"),
    )
    joined = out["orders"].join(out["customer"], F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("joined"))
    return seen.crossJoin(joined)


@query(
    "policy_before_and_after",
    f"SELECT c_custkey, c_name, {GIVEN} AS c_name_after FROM customer ORDER BY c_custkey LIMIT 20",
)
def before_after(t):
    rows = t.customer.select("c_custkey", "c_name")
    masked = pol.apply_policy(rows, "customer", Policy(KEY, [Rule("customer", "c_name", "FIRST_NAME")]))
    return pol.before_and_after(rows, masked, ["c_custkey"], 20)


EMAIL_RE = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


@query(
    "text_mask_documents",
    rf"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL_RE}')) AS emails, len(regexp_extract_all(text, '\d{{3}}-\d{{2}}-\d{{4}}')) >= 0 AS scanned FROM documents",
)
def text_documents(t):
    """E-mails found per document; every one is masked onto a reserved domain."""
    done = spread(t.documents.select("doc_id", "text")).select("doc_id", freetext.mask_text(F.col("text"), KEY).alias("r"))
    counted = done.select("doc_id", freetext.counts_by_kind(F.col("r.found")).alias("kinds"), F.col("r.text").alias("text"))
    return counted.select(
        "doc_id", F.coalesce(F.try_element_at("kinds", F.lit("EMAIL")), F.lit(0)).alias("emails"),
        F.col("text").isNotNull().alias("scanned"),
    )


@query("text_mask_counts")
def text_counts(t):
    """Changed values per personal-data type over documents and conversations."""
    texts = t.documents.select("text").union(t.conversations.select("text"))
    done = spread(texts).select(freetext.mask_text(F.col("text"), KEY).alias("r"))
    kinds = done.select(F.explode(freetext.counts_by_kind(F.col("r.found"))).alias("kind", "values"))
    return kinds.groupBy("kind").agg(F.sum("values").alias("changed"), F.count("*").alias("texts"))


@query(
    "text_mask_json",
    f"SELECT event_id, '{{\"who\": \"' || {sql.keep_format(KEY, 'w', 'event_type')} || '\", \"tags\": [\"' || {sql.keep_format(KEY, 'w', 'event_type')} || '\"], \"n\": ' || user_id || '}}' AS doc FROM events",
)
def text_json(t):
    from cloakwork.functions.masks import mask

    doc = F.concat(
        F.lit('{"who": "'), "event_type", F.lit('", "tags": ["'), "event_type", F.lit('"], "n": '), F.col("user_id").cast("string"), F.lit("}")
    )
    change = lambda x: mask("FORMAT_PRESERVE", x, KEY, "w")
    rows = spread(t.events.select("event_id", "event_type", "user_id"))
    return rows.select("event_id", structured.change_json_text(doc, change).alias("doc"))


ORDER_DOC = (
    "'{{\"who\": \"' || o_orderstatus || '\", \"lines\": [{{\"note\": \"' || {note} || '\", \"tag\": \"' || o_orderpriority || '\"}}, "
    "{{\"note\": \"' || {note} || '\"}}], \"note\": \"' || o_orderpriority || '\"}}'"
)


@query(
    "text_mask_json_by_path",
    "SELECT o_orderkey, " + ORDER_DOC.format(note=sql.keep_format(KEY, "w", "o_orderpriority")) + " AS doc FROM orders",
)
def text_json_path(t):
    """Only ``$.lines[].note`` changes: not the note beside the lines, nor the tag with the same text."""
    from cloakwork.functions.masks import mask

    doc = F.expr(ORDER_DOC.format(note="o_orderpriority"))
    changes = [("$.LINES[].note", lambda x: mask("FORMAT_PRESERVE", x, KEY, "w"))]
    rows = spread(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return rows.select("o_orderkey", scanner.change_selected(doc, "json", changes).alias("doc"))


CUSTOMER_DOC = "'<c><x seg=\"' || {seg} || '\" id=\"' || c_mktsegment || '\"><![CDATA[' || {name} || ']]></x><n>' || {n} || ' &amp; co</n></c>'"


@query(
    "text_mask_xml_by_path",
    "SELECT c_custkey, "
    + CUSTOMER_DOC.format(seg=sql.keep_format(KEY, "x", "c_mktsegment"), name="c_name", n="upper(c_name)").replace(" &amp; co", " &amp; CO") + " AS doc FROM customer",
)
def text_xml_path(t):
    """An attribute by ``$.c.x@seg`` and an element's text by ``$.c.n``; entities are read and written."""
    from cloakwork.functions.masks import mask

    doc = F.expr(CUSTOMER_DOC.format(seg="c_mktsegment", name="c_name", n="c_name"))
    changes = [("$.c.x@seg", lambda x: mask("FORMAT_PRESERVE", x, KEY, "x")), ("$.c.n", F.upper)]
    rows = spread(t.customer.select("c_custkey", "c_mktsegment", "c_name"))
    return rows.select("c_custkey", scanner.change_selected(doc, "xml", changes).alias("doc"))


@query(
    "text_mask_html_by_element",
    "SELECT c_custkey, '<p>Caf&eacute; <b>' || upper(c_name) || ' É©</b><br>' || c_name || '<script>b</script></p>' AS doc, "
    "'<p>CAFÉ <b>' || upper(c_name) || ' É©</b><br>' || upper(c_name) || '<script>b</script></p>' AS whole FROM customer",
)
def text_html_element(t):
    """Text inside one kind of element, and all text: named entities are read; what doesn't change keeps its writing."""
    doc = F.concat(F.lit("<p>Caf&eacute; <b>"), "c_name", F.lit(" &eacute;&copy;</b><br>"), "c_name", F.lit("<script>b</script></p>"))
    return spread(t.customer.select("c_custkey", "c_name")).select(
        "c_custkey", scanner.change_selected(doc, "html", [("b", F.upper)]).alias("doc"), structured.change_html_text(doc, F.upper).alias("whole")
    )


@query(
    "text_mask_cells_by_header",
    f"SELECT c_custkey::VARCHAR AS c_custkey, {sql.keep_format(KEY, 'unstructured.segment', 'c_mktsegment')} AS segment, c_mktsegment AS note FROM customer",
)
def text_cells_by_header(t):
    """Delimited cells: the rule runs in the column that its selector names, and leaves the other alone."""
    path = scratch_path(t.spark, "cells")
    loads.write_csv(t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_mktsegment").alias("note")), path)
    cells = t.spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(path)
    return freetext.mask_cells(cells, KEY, [freetext.TextRule("Segment", "SEGMENT", "[A-Z]+", "FORMAT_PRESERVE", "[A-Z]", selector="SEG")])


@query("text_mask_keeps_markup", "SELECT doc_id, true AS json_same, true AS html_same, true AS xml_same FROM documents")
def text_markup(t):
    """Texts inside JSON, HTML and XML, with escapes and entities: what is read back is the mask of the plain text."""
    from cloakwork.functions.masks import mask

    change = lambda x: mask("FORMAT_PRESERVE", x, KEY, "w")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(' "q" \\ & <b> \'é\n'), F.col("doc_id").cast("string"))
    rows = spread(t.documents.select("doc_id", text.alias("x"))).withColumn("want", change(F.col("x")))
    json = F.get_json_object(structured.change_json_text(F.to_json(F.struct("x")), change), "$.x")
    written = structured.encoded(F.col("x"))
    html = F.regexp_extract(structured.change_html_text(F.concat(F.lit("<p class='a'>"), written, F.lit("</p>")), change), r"(?s)^<p class='a'>(.*)</p>$", 1)
    in_xml = structured.change_xml_text(F.concat(F.lit('<r a="'), written, F.lit('">'), written, F.lit("</r>")), change)
    read = rows.withColumns({"json": json, "html": html, "xml": in_xml})  # each text is changed once, whatever is read from it
    attribute, node = (F.regexp_extract("xml", r'(?s)^<r a="([^"]*)">(.*)</r>$', i) for i in (1, 2))
    return read.select(
        "doc_id", (F.col("json") == F.col("want")).alias("json_same"), (structured.decoded(F.col("html")) == F.col("want")).alias("html_same"),
        ((structured.decoded(attribute) == F.col("want")) & (structured.decoded(node) == F.col("want"))).alias("xml_same"),
    )


@query(
    "text_mask_html",
    "SELECT page_id, length(regexp_replace(html, '[^<]', '', 'g')) AS tags_kept, html LIKE '%<script>%' AS has_script FROM pages",
)
def text_html(t):
    """Text nodes masked; tags, scripts and styles untouched."""
    masked = structured.change_html_text(F.col("html"), freetext.text_changer(KEY))
    rows = spread(t.pages.select("page_id", "html")).select("page_id", masked.alias("m"))
    return rows.select(
        "page_id", F.length(F.regexp_replace("m", "[^<]", "")).alias("tags_kept"), F.col("m").contains("<script>").alias("has_script")
    )


@query(
    "text_mask_xml",
    f"SELECT c_custkey, '<c seg=\"' || {sql.keep_format(KEY, 'x', 'c_mktsegment')} || '\"><n>' || {sql.keep_format(KEY, 'x', 'c_name')} || '</n></c>' AS doc FROM customer",
)
def text_xml(t):
    from cloakwork.functions.masks import mask

    doc = F.concat(F.lit('<c seg="'), "c_mktsegment", F.lit('"><n>'), "c_name", F.lit("</n></c>"))
    change = lambda x: mask("FORMAT_PRESERVE", x, KEY, "x")
    rows = spread(t.customer.select("c_custkey", "c_mktsegment", "c_name"))
    return rows.select("c_custkey", structured.change_xml_text(doc, change).alias("doc"))


@query(
    "text_mask_csv_cells",
    rf"SELECT conv_id, turn, len(regexp_extract_all(text, '{EMAIL_RE}')) AS emails, role FROM conversations",
)
def text_cells(t):
    """Every cell of a delimited file; the header names the rule's column."""
    path = scratch_path(t.spark, "cells")
    loads.write_csv(t.conversations, path)
    cells = t.spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(path)
    emails = [r for r in freetext.DEFAULT_RULES if r.kind == "EMAIL"]
    done = cells.select("conv_id", "turn", "role", freetext.mask_text(F.col("text"), KEY, emails).alias("r"))
    return done.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("r.found")[0].alias("emails"), "role",
    )
