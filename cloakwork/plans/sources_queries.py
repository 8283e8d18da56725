"""Sources and sinks: data derived from the given tables is written in each form and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions.masks import mask
from cloakwork.operators import loads
from cloakwork.operators import mapping as ops
from cloakwork.plans import sqltext as sql
from cloakwork.plans.keys import KEY
from cloakwork.plans.registry import query
from cloakwork.session import scratch_path
from cloakwork.sources import files
from cloakwork.sources import fixed_records as rec
from cloakwork.sources import versions
from cloakwork.sources.fixed_records import FieldAt


@query("source_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def scan(t):
    return ops.scan(t.orders, "o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("source_sql_query", "WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT * FROM b WHERE n > 50")
def sql_source(t):
    t.customer.createOrReplaceTempView("customer_for_sql")
    return ops.sql_source(t.spark, "WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer_for_sql GROUP BY 1) SELECT * FROM b WHERE n > 50")


for label, sep in (("csv", ","), ("tsv", "\t")):

    @query(f"source_{label}_file", "SELECT doc_id, text, lang FROM documents")
    def delimited(t, sep=sep, label=label):
        """Texts with quotes, commas and line breaks survive the round trip."""
        path = scratch_path(t.spark, label)
        loads.write_csv(t.documents.select("doc_id", "text", "lang"), path, sep)
        return files.read_delimited(t.spark, path, sep, multi_line=True).withColumn("doc_id", F.col("doc_id").cast("bigint"))


ROWS_SCHEMA = "id bigint, kind string, inner struct<k:bigint,tags:array<string>>"
INNER = "'{\"k\":' || regexp_extract(props, '[0-9]+') || ',\"tags\":[\"' || event_type || '\"]}'"


def event_rows(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.struct(k.alias("k"), F.array("event_type").alias("tags")).alias("inner"))


@query("source_json_lines", f"SELECT event_id AS id, event_type AS kind, {INNER} AS inner FROM events")
def json_lines(t):
    path = scratch_path(t.spark, "jsonl")
    loads.write_json(event_rows(t), path)
    return files.read_json_lines(t.spark, path, ROWS_SCHEMA)


@query("source_json_document", f"SELECT n_nationkey AS id, n_name AS kind FROM nation")
def json_document(t):
    """One array per region as a document of its own."""
    path = scratch_path(t.spark, "json-doc")
    rows = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("kind")))))
    t.nation.groupBy("n_regionkey").agg(rows.alias("value")).select("value").write.option("lineSep", "\n").partitionBy().text(path)
    lines = t.spark.read.text(path)
    one = scratch_path(t.spark, "json-one")
    lines.select("value", F.sha2("value", 256).substr(1, 8).alias("file")).write.partitionBy("file").text(one)
    return files.read_json_document(t.spark, one, "id int, kind string").select("id", "kind")


@query("source_xml_file", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def xml(t):
    path = scratch_path(t.spark, "xml")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    rows.write.options(rootTag="suppliers", rowTag="supplier").xml(path)
    return files.read_xml(t.spark, path, "supplier", "id bigint, name string, nation int")


@query("source_flatten_json_column", "SELECT event_id, regexp_extract(props, '[0-9]+') AS k, NULL::VARCHAR AS missing, NULL::VARCHAR AS value FROM events")
def flatten(t):
    return files.flatten_json(t.events, "props", ["k", "missing"], ["event_id"])


@query(
    "source_infer_types",
    "SELECT * FROM (VALUES ('id', 'NUMBER'), ('price', 'NUMBER'), ('day', 'DATE'), ('stamp', 'TIMESTAMP'), ('flag', 'BOOLEAN'), ('mixed', 'STRING'), ('nothing', 'UNKNOWN')) v(column_name, inferred) WHERE (SELECT count(*) FROM orders) > 0",
)
def infer(t):
    path = scratch_path(t.spark, "typed")
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), (F.col("o_orderstatus") == "O").alias("flag"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("x").alias("mixed"), F.lit(None).cast("string").alias("nothing"),
    )
    loads.write_csv(rows, path)
    return files.infer_types(files.read_delimited(t.spark, path)).select("column_name", "inferred")


LAYOUT = [
    FieldAt("id", 1, 8, "BINARY"), FieldAt("name", 9, 20), FieldAt("nation", 29, 4, "ZONED"), FieldAt("balance", 33, 6, "PACKED", 2), FieldAt("segment", 40, 10),
]
LENGTH = 50


def customers_for_records(t):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def stored_records(t):
    path = scratch_path(t.spark, "records")
    rec.write_records(rec.encode(customers_for_records(t), LAYOUT, LENGTH), path).collect()
    return rec.read_records(t.spark, path, LENGTH)


@query(
    "source_fixed_length_records",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
)
def fixed_records(t):
    """Packed, zoned, binary and EBCDIC fields written as fixed-length files and decoded again."""
    return rec.decode(stored_records(t), LAYOUT).withColumn("balance", F.col("balance").cast("double"))


@query(
    "mask_fixed_length_records",
    f"SELECT c_custkey AS id, substr({sql.first_name(KEY, 'name.first', 'c_name')}, 1, 20) AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance FROM customer",
)
def mask_records(t):
    """Only the named field is overlaid in the original bytes."""
    changed = rec.rewrite_fields(stored_records(t), LAYOUT, {"name": mask("FIRST_NAME", F.col("name"), KEY)})
    return rec.decode(changed, LAYOUT[:4]).withColumn("balance", F.col("balance").cast("double"))


@query("generate_fixed_length_records", "SELECT count(*) AS records, 50 * count(*) AS bytes FROM customer")
def record_files(t):
    path = scratch_path(t.spark, "generated-records")
    written = rec.write_records(rec.encode(customers_for_records(t), LAYOUT, LENGTH), path)
    return written.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


@query(
    "generate_fixed_length_records_again",
    "SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer",
)
def record_files_again(t):
    """Written twice, the second time in fewer partitions: the files that are read are those of the second run alone."""
    root = scratch_path(t.spark, "record-versions")
    records = rec.encode(customers_for_records(t), LAYOUT, LENGTH)
    rec.store_records(t.spark, records.repartition(5), root)
    rec.store_records(t.spark, records.coalesce(1), root)
    return rec.decode(rec.stored_records(t.spark, root, LENGTH), LAYOUT).withColumn("balance", F.col("balance").cast("double"))


@query("sink_file_digest", "SELECT 'csv' AS form, count(*) AS n_rows, true AS same FROM part UNION ALL SELECT 'json', count(*), true FROM part")
def digests(t):
    """Row count and digest seen while writing agree with the files read back."""
    parts = []
    rows = t.part.select("p_partkey", "p_name", "p_size")
    for form in ("csv", "json"):
        path = scratch_path(t.spark, form)
        seen = loads.write_csv(rows, path) if form == "csv" else loads.write_json(rows, path)
        back = t.spark.read.schema(rows.schema).options(header=True).format(form).load(path)
        parts.append(
            back.agg(F.count("*").alias("n_rows"), F.sum(loads.row_digest(back.columns).cast("decimal(38,0)")).alias("d"))
            .select(F.lit(form).alias("form"), "n_rows", (F.col("d") == F.lit(seen["digest"])).alias("same"))
        )
    return parts[0].union(parts[1])


@query("load_replace", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def load_replace(t):
    path = scratch_path(t.spark, "replace")
    loads.replace(t.supplier.select("s_suppkey", "s_name"), path)
    loads.replace(t.supplier.where("s_acctbal > 0").select("s_suppkey", "s_name"), path)
    return t.spark.read.parquet(path)


@query("load_append", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def load_append(t):
    path = scratch_path(t.spark, "append")
    loads.replace(t.supplier.select("s_suppkey", "s_name"), path)
    loads.append(t.supplier.where("s_acctbal > 0").select("s_suppkey", "s_name"), path)
    return t.spark.read.parquet(path)


def changed_orders(t):
    """Every third order closed (its priority becomes null), and new orders beyond the last key."""
    old = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("C").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    new = t.orders.where("o_orderkey % 100 = 1").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_orderpriority")
    return old.union(new)


UPDATED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"


def order_target(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("load_update", UPDATED)
def load_update(t):
    return loads.updated(order_target(t), changed_orders(t), ["o_orderkey"])


@query("load_upsert", UPDATED + " UNION ALL SELECT o_orderkey + 100000000, NULL, 'N', o_orderpriority FROM orders WHERE o_orderkey % 100 = 1")
def load_upsert(t):
    return loads.upserted(order_target(t), changed_orders(t), ["o_orderkey"])


@query("load_truncate_and_prepare", "SELECT 'truncated' AS step, 0 AS n_rows FROM (SELECT count(*) FROM supplier) UNION ALL SELECT 'deleted', count(*) FROM supplier WHERE s_nationkey <> 3")
def load_prepare(t):
    one, two = scratch_path(t.spark, "truncate"), scratch_path(t.spark, "delete")
    for path in (one, two):
        loads.replace(t.supplier, path)
    loads.prepare(t.spark, one, "TRUNCATE")
    loads.prepare(t.spark, two, "DELETE", "s_nationkey = 3")
    count = lambda path, name: t.spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("step"), "n_rows")
    return count(one, "truncated").union(count(two, "deleted"))


@query("load_in_place", f"SELECT c_custkey, {sql.first_name(KEY, 'name.first', 'c_name')} AS c_name, c_acctbal FROM customer")
def load_in_place(t):
    path = scratch_path(t.spark, "in-place")
    loads.replace(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    loads.rewrite_in_place(t.spark, path, lambda rows: rows.withColumn("c_name", mask("FIRST_NAME", F.col("c_name"), KEY)))
    return t.spark.read.parquet(path)


@query("load_in_place_by_pointer", f"SELECT c_custkey, {sql.first_name(KEY, 'name.first', 'c_name')} AS c_name, c_acctbal FROM customer")
def load_by_pointer(t):
    """The table is rewritten beside itself, and one small file makes readers follow the new folder."""
    root = scratch_path(t.spark, "versions")
    versions.store(t.spark, root, t.customer.select("c_custkey", "c_name", "c_acctbal"))
    versions.rewrite(t.spark, root, lambda rows: rows.withColumn("c_name", mask("FIRST_NAME", F.col("c_name"), KEY)))
    return versions.read(t.spark, root)


@query(
    "load_replace_partition",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN {sql.pick(KEY, 'prio|secure-lookup', sql.normal('o_orderpriority'), ['low', 'high'])} ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders",
)
def load_partition(t):
    path = scratch_path(t.spark, "partitions")
    t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    rows = t.spark.read.parquet(path).where("o_orderstatus = 'P'")
    masked = rows.withColumn("o_orderpriority", mask("SECURE_LOOKUP", F.col("o_orderpriority"), KEY, "prio", "low|high"))
    loads.replace_partitions(masked, path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


ROUTES = {"big": "o_totalprice > 400000", "open": "o_orderstatus = 'O'", "rest": None}


@query(
    "load_routes",
    "SELECT 'big' AS route, count(*) AS n_rows FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' "
    "UNION ALL SELECT 'rest', count(*) FROM orders WHERE NOT (o_totalprice > 400000 OR o_orderstatus = 'O')",
)
def load_routes(t):
    path = scratch_path(t.spark, "routes")
    loads.load_routes(t.orders, ROUTES, path)
    return t.spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n_rows"))


@query(
    "load_rejects",
    "SELECT event_id, 'amount' AS rejected_for FROM events WHERE event_id % 11 = 0",
)
def load_rejects(t):
    amount = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    fitted = loads.split_rejects(t.events.select("event_id", amount.alias("amount")), {"amount": "decimal(12,2)"}, ["amount"])
    loads.check_rejects(fitted, 10**9)
    return fitted.rejected.select("event_id", F.array_join("rejected_for", ",").alias("rejected_for"))


@query(
    "load_several_targets",
    "SELECT c_custkey::VARCHAR AS id, c_name AS label, 'crm' AS target FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_mktsegment, 'billing' FROM customer",
)
def several_targets(t):
    out = ops_targets(t)
    return (
        out["crm"].select(F.col("id").cast("string").alias("id"), "label", F.lit("crm").alias("target"))
        .union(out["billing"].select(F.col("account").cast("string"), "segment", F.lit("billing")))
    )


def ops_targets(t):
    return loads.project_targets(t.customer, {"crm": {"id": "c_custkey", "label": "c_name"}, "billing": {"account": "c_custkey", "segment": "c_mktsegment"}})


@query(
    "load_fit_to_target",
    "SELECT c_custkey, left(c_name, 12) AS name, CAST(c_acctbal AS DECIMAL(12,2))::DOUBLE AS balance, c_nationkey > 5 AS far FROM customer",
)
def fit(t):
    return t.customer.select(
        "c_custkey", loads.fit(F.col("c_name"), T.StringType(), 12).alias("name"),
        loads.fit(F.col("c_acctbal").cast("decimal(12,2)"), T.DecimalType(12, 2), name="balance").cast("double").alias("balance"),
        loads.fit(F.when(F.col("c_nationkey") > 5, "Y").otherwise("n"), T.BooleanType(), name="far").alias("far"),
    )


@query("preview_rows", "SELECT 100 AS shown, true AS truncated FROM (SELECT count(*) FROM orders)")
def preview(t):
    rows, more = ops.preview(t.orders)
    return rows.agg(F.count("*").alias("shown")).withColumn("truncated", F.lit(more))


@query("page_in_key_order", "SELECT o_orderkey, o_totalprice, true AS has_more FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200")
def page(t):
    rows, more = ops.page(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 200)
    return rows.withColumn("has_more", F.lit(more))


@query("page_of_any_size", "SELECT o_orderkey, true AS has_more FROM orders ORDER BY o_orderkey LIMIT 300")
def large_page(t):
    rows, more = ops.page(t.orders.select("o_orderkey"), ["o_orderkey"], 300)
    return rows.withColumn("has_more", F.lit(more))


@query("create_target_like_source", "SELECT 0 AS n_rows, 11 AS n_columns FROM (SELECT count(*) FROM lineitem)")
def create_like(t):
    path = scratch_path(t.spark, "like")
    loads.create_like(t.spark, t.lineitem, path)
    made = t.spark.read.parquet(path)
    return made.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(made.columns)))


@query("source_change_feed", "SELECT event_id AS id, event_type AS op FROM events")
def change_feed(t):
    """Feed read as a stream in small files; the checkpoint remembers the position."""
    from cloakwork.streaming import changes as chg

    source, out, mark = (scratch_path(t.spark, x) for x in ("feed", "seen", "position"))
    t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("op")).repartition(3, "id").write.json(source)
    stream = chg.feed_stream(t.spark, source, schema=T.StructType.fromDDL("id bigint, op string"), files=1)
    chg.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), mark)
    return t.spark.read.parquet(out).drop("batch")


@query("source_jdbc_split_read", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def jdbc(t):
    """Rows written to a database over JDBC and read back in key ranges by separate tasks."""
    url = f"jdbc:derby:memory:{scratch_path(t.spark, 'db').rsplit('/', 1)[-1]};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    files.write_jdbc(rows, url, "SUPPLIERS", "overwrite", **driver)
    top = rows.agg(F.max("s_suppkey")).first()[0]
    back = files.read_jdbc(t.spark, url, "SUPPLIERS", "s_suppkey", 0, top + 1, 4, **driver)
    return back.select(*[F.col(c.upper()).alias(c) for c in rows.columns])
