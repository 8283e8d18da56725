"""Schema drift, business entities, identity links and reservations."""

import datetime as dt

from pyspark.sql import functions as F

from cloakwork.operators import drift as dr
from cloakwork.operators import entities as ent
from cloakwork.operators import loads
from cloakwork.operators.subset import Edge
from cloakwork.plans.changes_queries import row_sql
from cloakwork.plans.keys import EDGES
from cloakwork.plans.registry import query
from cloakwork.session import scratch_path

PART = ["p_partkey", "p_name", "p_brand", "p_size"]


@query(
    "schema_observed_profile",
    " UNION ALL ".join(
        f"SELECT 'part' AS table_name, '{c}' AS column_name, '{k}' AS type, count(*) FILTER ({c} IS NULL) > 0 AS nullable, max(length({c}::VARCHAR)) AS length FROM part"
        for c, k in zip(PART, ("bigint", "string", "string", "int"))
    ),
)
def observed(t):
    return dr.observed_profile({"part": t.part.select(*PART)}).drop("scale")


@query(
    "schema_key_profile",
    "SELECT 'orders' AS table_name, 'KEY o_orderkey' AS rule, 0 AS broken FROM (SELECT count(*) FROM orders) UNION ALL "
    "SELECT 'lineitem', 'KEY l_orderkey,l_linenumber', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL "
    "SELECT 'orders', 'FK o_custkey->customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)",
)
def key_profile(t):
    tables = {"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer.where("c_nationkey <> 3")}
    return dr.key_profile(tables, {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}, [Edge("orders", "o_custkey", "customer", "c_custkey")])


def changed_orders(t):
    """A changed copy: dropped and new columns, another type, shorter text, injected nulls."""
    return t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.substring("o_orderpriority", 1, 3).alias("o_orderpriority"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderdate", F.lit("x").alias("o_channel"),
    )


@query(
    "schema_drift_columns",
    "SELECT * FROM (VALUES ('o_totalprice', 'COLUMN_MISSING', 'BLOCKER'), ('o_channel', 'COLUMN_ADDED', 'INFO'), ('o_custkey', 'DATA_TYPE_CHANGED', 'HIGH'), "
    "('o_orderpriority', 'LENGTH_NARROWED', 'HIGH'), ('o_orderstatus', 'NULLABILITY_RELAXED', 'MEDIUM')) v(column_name, issue, severity) WHERE (SELECT count(*) FROM orders) > 0",
)
def drift_columns(t):
    before, after = dr.observed_profile({"orders": t.orders}), dr.observed_profile({"orders": changed_orders(t)})
    return dr.column_drift(before, after).where("issue <> 'SCALE_CHANGED'").select("column_name", "issue", "severity")


@query(
    "schema_drift_tables_and_keys",
    "SELECT * FROM (VALUES ('part', 'TABLE_MISSING', 'BLOCKER'), ('supplier', 'TABLE_CREATED', 'INFO'), ('orders', 'FOREIGN_KEY_CHANGED', 'HIGH'), ('orders', 'UNIQUE_CONSTRAINT_CHANGED', 'HIGH')) "
    "v(table_name, issue, severity) WHERE (SELECT count(*) FROM orders) > 0",
)
def drift_tables(t):
    before = dr.observed_profile({"orders": t.orders, "part": t.part})
    after = dr.observed_profile({"orders": t.orders, "supplier": t.supplier})
    edges = [Edge("orders", "o_custkey", "customer", "c_custkey")]
    good = dr.key_profile({"orders": t.orders, "customer": t.customer}, {"orders": ["o_orderkey"]}, edges)
    doubled = t.orders.union(t.orders.where("o_orderkey % 10 = 0"))
    bad = dr.key_profile({"orders": doubled, "customer": t.customer.where("c_custkey % 2 = 0")}, {"orders": ["o_orderkey"]}, edges)
    return dr.table_drift(before, after).union(dr.key_drift(good, bad).select("table_name", "issue", "severity"))


@query("schema_drift_gate", "SELECT true AS stopped, count(*) AS loaded FROM part")
def gate(t):
    """A blocking drift stops the load of orders; the unchanged part table is loaded."""
    path = scratch_path(t.spark, "gated")
    bad = dr.column_drift(dr.observed_profile({"orders": t.orders}), dr.observed_profile({"orders": changed_orders(t)}))
    try:
        dr.gated_load(bad, lambda: loads.replace(changed_orders(t), path))
        stopped = False
    except ValueError:
        stopped = True
    same = dr.observed_profile({"part": t.part})
    dr.gated_load(dr.column_drift(same, same), lambda: loads.replace(t.part, path))
    return t.spark.read.parquet(path).agg(F.lit(stopped).alias("stopped"), F.count("*").alias("loaded"))


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus"]


def customer_members(t):
    return [
        ent.Member("orders", t.orders.select(*ORDER), "o_custkey"),
        ent.Member("lineitem", t.lineitem.select(*LINE), hop=("l_orderkey", t.orders, "o_orderkey", "o_custkey")),
    ]


def lane(columns):
    sums = " || ':' || ".join(f"sum(('0x' || substr(sha256({row_sql(columns)}), {1 + 8 * i}, 8))::UBIGINT)::BIGINT" for i in range(4))
    return f"sha256(count(*) || ':' || {sums})"


@query(
    "entity_assemble_all_keys",
    f"SELECT o_custkey AS entity, 'orders' AS member, count(*) AS n_rows, {lane(ORDER)} AS digest FROM orders GROUP BY 1 UNION ALL "
    f"SELECT o_custkey, 'lineitem', count(*), {lane(LINE)} FROM lineitem JOIN (SELECT o_orderkey, o_custkey FROM orders) ON l_orderkey = o_orderkey GROUP BY 1",
)
def assemble(t):
    """Orders and line items of every customer; large members are cut into parts, none is dropped."""
    return ent.capsule(ent.fragments(customer_members(t), 20)).select("entity", "member", "n_rows", "digest")


@query(
    "entity_fragment_rows",
    "SELECT o_custkey AS entity, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
)
def fragment_rows(t):
    """Rows come back complete from their fragments."""
    parts = ent.fragments(customer_members(t)[:1], 5)
    rows = parts.select("entity", F.explode("rows").alias("row")).select("entity", F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("k"))
    return rows.groupBy("entity").agg(F.count("*").alias("n_rows"), F.sum("k").alias("keys"))


@query(
    "entity_versions_and_restore",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS version, c_acctbal FROM customer",
)
def versions(t):
    """Version 2 changes the balance, version 3 (even keys) restores version 1; odd keys were re-read unchanged."""
    now = t.customer.select("c_custkey", "c_acctbal")
    history = now.withColumn("version", F.lit(1)).withColumn("label", F.lit("FIRST"))
    changed = now.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    second = ent.add_version(history, changed, "c_custkey", "SECOND")
    even = second.where("c_custkey % 2 = 0")
    third = ent.restore_version(even, "c_custkey", 1).unionByName(second.where("c_custkey % 2 = 1"))
    return ent.newest(third, "c_custkey").select("c_custkey", "version", "c_acctbal")


@query(
    "entity_provision",
    "SELECT o_orderkey, o_custkey, 'M' AS o_orderstatus FROM orders WHERE o_custkey % 4 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 4 <> 0",
)
def provision(t):
    target = t.orders.select(*ORDER)
    rows = target.where("o_custkey % 4 = 0").withColumn("o_orderstatus", F.lit("M"))
    return ent.provision(target, rows, ["o_orderkey"])


@query("entity_member_counts", "SELECT 'orders' AS member, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def member_counts(t):
    return ent.member_counts(customer_members(t), {"orders": "o_orderstatus = 'O'"})


def crosswalk(t):
    """Customers known to two systems; every tenth link of the second one leads to another subject."""
    subject = F.concat(F.lit("S"), F.col("c_custkey").cast("string"))
    day = F.lit(dt.datetime(2024, 1, 1))
    crm = ent.links(t.customer, "crm", ["c_custkey"], subject, day)
    again = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).otherwise(subject)
    return crm.union(ent.links(t.customer, "CRM", ["c_custkey"], again, F.lit(dt.datetime(2024, 2, 1)))).withColumn("active", F.lit(True))


@query(
    "identity_link_conflicts",
    "SELECT sha256('crm' || chr(31) || c_custkey) AS link, 2 AS subjects FROM customer WHERE c_custkey % 10 = 0",
)
def link_conflicts(t):
    return ent.link_conflicts(crosswalk(t)).select("link", "subjects")


@query(
    "identity_resolve",
    "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'T' ELSE 'S' END || o_custkey AS subject FROM orders",
)
def resolve(t):
    requests = t.orders.select("o_orderkey", ent.link_hash("crm", [F.col("o_custkey")]).alias("link"))
    return ent.resolve(requests, crosswalk(t)).select("o_orderkey", "subject")


NOW = dt.datetime(2024, 1, 15)


def reservations(t):
    """One reservation per order on its customer; it ends when the 1st of 2024 plus (order key mod 30) days is over."""
    ends = F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    return t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("entity"), F.concat(F.lit("team"), (F.col("o_orderkey") % 4).cast("string")).alias("holder"), F.lit("ACTIVE").alias("status"), ends.alias("expires_at"))


TAKEN = "SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 30 > 14"


@query(
    "reserve_free_keys",
    f"SELECT c_custkey AS entity, 'me' AS holder, 'ACTIVE' AS status FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN ({TAKEN}) ORDER BY c_custkey LIMIT 15",
)
def reserve(t):
    out = ent.reserve(t.customer, "c_custkey", "c_mktsegment = 'BUILDING'", 15, reservations(t), NOW, "me", dt.datetime(2024, 3, 1))
    return out.select("entity", "holder", "status")


@query(
    "reservation_expiry_and_release",
    "SELECT CASE WHEN o_orderkey % 4 = 1 THEN 'RELEASED' WHEN o_orderkey % 30 <= 14 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status, count(*) AS n_rows FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1",
)
def expiry(t):
    return ent.expire(reservations(t), NOW, ["team1"]).groupBy("status").agg(F.count("*").alias("n_rows"))


@query("reservation_conflicts", f"SELECT c_custkey AS entity FROM customer WHERE c_nationkey = 3 AND c_custkey IN ({TAKEN})")
def conflicts(t):
    return ent.conflicts(t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("entity")), reservations(t), NOW)
