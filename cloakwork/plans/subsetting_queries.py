"""Referential subsetting over the foreign keys of the given tables."""

from pyspark.sql import functions as F

from cloakwork.operators import subset as sub
from cloakwork.operators.subset import Edge
from cloakwork.operators.policy import Policy, Rule, mask_tables
from cloakwork.plans.keys import EDGES, KEY, PRIMARY_KEYS
from cloakwork.plans import sqltext as sql
from cloakwork.plans.registry import query

CHAIN = ["region", "nation", "customer", "orders", "lineitem"]
ASIA = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"


def frames(t, names):
    return {n: getattr(t, n) for n in names}


def edges_of(names):
    return [e for e in EDGES if e.child in names and e.parent in names]


def keys_of(names):
    return {n: PRIMARY_KEYS[n] for n in names}


def chosen(t, names, driver, **options):
    return sub.plan_subset(frames(t, names), keys_of(names), edges_of(names), driver, **options)


@query(
    "subset_driver_seed",
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 40",
)
def driver_seed(t):
    return sub.seed(t.customer, ["c_custkey"], "c_mktsegment = 'BUILDING'", 40)


@query(
    "subset_keyless_slice",
    "SELECT 'events' AS table_name, count(*) AS selected_rows FROM events WHERE event_type = 'error' UNION ALL SELECT 'TOTAL', count(*) FROM events WHERE event_type = 'error'",
)
def keyless_slice(t):
    found = sub.plan_subset({"events": t.events}, {}, [], "events", "event_type = 'error'")
    return sub.row_counts(found, t.spark)


@query(
    "subset_extra_criteria",
    "SELECT 'customer' AS table_name, count(*) AS selected_rows FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL "
    "SELECT 'part', count(*) FROM part WHERE p_size > 40 UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') + (SELECT count(*) FROM part WHERE p_size > 40)",
)
def extra_criteria(t):
    found = chosen(
        t, ["customer", "part"], "customer", where="c_mktsegment = 'BUILDING'", parents=False, children=False,
        extra={"part": ("p_size > 40", None)},
    )
    return sub.row_counts(found, t.spark)


@query(
    "subset_children_of_keys",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)",
)
def child_keys(t):
    parents = t.customer.where("c_acctbal > 8000").select("c_custkey")
    return sub.children_of(t.orders, "o_custkey", ["o_orderkey"], parents, "c_custkey")


@query(
    "subset_parents_of_keys",
    "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 450000",
)
def parent_keys(t):
    picked = t.orders.where("o_totalprice > 450000").select("o_orderkey")
    return sub.parents_of(t.orders, ["o_orderkey"], picked, "o_custkey", t.customer, ["c_custkey"], "c_custkey")


COUNTS = (
    "WITH c AS (SELECT c_custkey {seed}), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), "
    "l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) "
)


@query(
    "subset_children_closure",
    COUNTS.format(seed=ASIA)
    + "SELECT 'customer' AS table_name, count(*) AS selected_rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l "
    "UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM c) + (SELECT count(*) FROM o) + (SELECT count(*) FROM l)",
)
def children_closure(t):
    return sub.row_counts(asia_subset(t), t.spark)


def asia_subset(t):
    names = ["customer", "orders", "lineitem"]
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    seeds = t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    closure = sub.Closure(frames(t, names), keys_of(names), edges_of(names), parents=False)
    return closure.run({"customer": seeds})


@query(
    "subset_parent_closure",
    "WITH o AS (SELECT * FROM orders WHERE o_totalprice > 400000), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), "
    "n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)) "
    "SELECT 'orders' AS table_name, count(*) AS selected_rows FROM o UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'nation', count(*) FROM n "
    "UNION ALL SELECT 'region', count(*) FROM r UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM o) + (SELECT count(*) FROM c) + (SELECT count(*) FROM n) + (SELECT count(*) FROM r)",
)
def parent_closure(t):
    found = chosen(t, CHAIN, "orders", where="o_totalprice > 400000", children=False)
    return sub.row_counts(found, t.spark)


@query(
    "subset_fixpoint_both_directions",
    "WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1) "
    "SELECT 'region' AS table_name, count(*) AS selected_rows FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation', count(*) FROM n UNION ALL "
    "SELECT 'customer', count(*) FROM customer WHERE c_nationkey IN (SELECT k FROM n) UNION ALL "
    "SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM n)) UNION ALL "
    "SELECT 'TOTAL', 1 + (SELECT count(*) FROM n) + (SELECT count(*) FROM customer WHERE c_nationkey IN (SELECT k FROM n)) + "
    "(SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM n)))",
)
def both_directions(t):
    names = ["region", "nation", "customer", "orders"]
    return sub.row_counts(chosen(t, names, "region", where="r_regionkey = 1"), t.spark)


@query(
    "subset_self_reference_chain",
    "WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 <> 0 THEN c_custkey - 1 END AS boss FROM customer), "
    "r AS (SELECT id FROM c WHERE id % 40 = 0 UNION SELECT c.id FROM c JOIN r ON c.boss = r.id) SELECT id FROM r",
)
def deep_chain(t):
    """Forty levels of one self reference, followed to their end by pointer doubling."""
    chain = t.customer.select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 40 <> 0 THEN c_custkey - 1 END").alias("boss"))
    found = sub.plan_subset({"chain": chain}, {"chain": ["id"]}, [Edge("chain", "boss", "chain", "id")], "chain", where="id % 40 = 0", parents=False)
    return found.keys["chain"].select("id")


@query("subset_cap_leaves_no_orphans", "SELECT true AS capped, 0 AS lost_orders, 0 AS lost_lines FROM (SELECT count(*) FROM orders)")
def cap_orphans(t):
    """A cap on customers also drops the orders of customers that it cuts off, and their lines."""
    names = ["nation", "customer", "orders", "lineitem"]
    found = chosen(t, names, "nation", where="n_regionkey = 1", directives={"customer": sub.Directive(limit=5)})
    kept = sub.extract(frames(t, names), keys_of(names), found)
    orders = kept["orders"].join(kept["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("lost_orders"))
    lines = kept["lineitem"].join(kept["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("lost_lines"))
    return kept["customer"].agg((F.count("*") == 5).alias("capped")).crossJoin(orders).crossJoin(lines)


@query(
    "subset_directives",
    "WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000), "
    "o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) AND o_orderstatus = 'O'), "
    "p AS (SELECT p_partkey FROM part WHERE p_size = 1) "
    "SELECT 'customer' AS table_name, count(*) AS selected_rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'part', count(*) FROM p "
    "UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM c) + (SELECT count(*) FROM o) + (SELECT count(*) FROM p)",
)
def directives(t):
    names = ["nation", "customer", "orders", "lineitem", "part"]
    found = chosen(
        t, names, "customer", where="c_acctbal > 5000",
        directives={
            "orders": sub.Directive(where="o_orderstatus = 'O'"), "lineitem": sub.Directive("EXCLUDED"),
            "part": sub.Directive("INDEPENDENT", where="p_size = 1"), "customer": sub.Directive(parents="NO"),
        },
    )
    return sub.row_counts(found, t.spark)


@query(
    "subset_deferred_phase",
    "WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT k FROM n)), "
    "o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) "
    "SELECT 'nation' AS table_name, count(*) AS selected_rows, 1 AS last_found FROM n UNION ALL SELECT 'customer', count(*), 2 FROM c UNION ALL SELECT 'orders', count(*), 4 FROM o",
)
def deferred(t):
    names = ["region", "nation", "customer", "orders"]
    found = chosen(
        t, names, "region", where="r_regionkey = 2", parents=False,
        directives={
            "region": sub.Directive(), "nation": sub.Directive(), "customer": sub.Directive(children="DEFER"),
            "orders": sub.Directive(),
        },
    )
    parts = [
        found.keys[n].agg(F.count("*").alias("selected_rows"), F.max("found_in").alias("last_found")).select(
            F.lit(n).alias("table_name"), "selected_rows", "last_found"
        )
        for n in ("nation", "customer", "orders")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "subset_filter_after_closure",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)
def filter_after(t):
    found = chosen(
        t, ["customer", "orders"], "customer", where="c_nationkey = 3",
        directives={"orders": sub.Directive(where="o_orderstatus = 'F'"), "customer": sub.Directive()},
    )
    return found.keys["orders"].select("o_orderkey")


@query(
    "subset_cap_by_discovery",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY o_orderkey LIMIT 50",
)
def capped(t):
    found = chosen(
        t, ["customer", "orders"], "customer", where="c_nationkey = 3",
        directives={"orders": sub.Directive(limit=50), "customer": sub.Directive()},
    )
    return found.keys["orders"].select("o_orderkey")


def region_policy():
    return Policy(
        KEY,
        [
            Rule("customer", "c_name", "FULL_NAME"), Rule("customer", "c_custkey", "FORMAT_PRESERVE"),
            Rule("orders", "o_custkey", "FORMAT_PRESERVE"), Rule("orders", "o_orderkey", "FORMAT_PRESERVE"),
            Rule("lineitem", "l_orderkey", "FORMAT_PRESERVE"), Rule("orders", "o_orderdate", "DATE_SHIFT", p1="30"),
        ],
    )


@query(
    "subset_extract_and_mask",
    COUNTS.format(seed=ASIA)
    + "SELECT 'customer' AS table_name, count(*) AS n_rows, 0 AS unmasked FROM c UNION ALL SELECT 'orders', count(*), 0 FROM o UNION ALL "
    "SELECT 'lineitem', count(*), 0 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)",
)
def extract_and_mask(t):
    """Rows per table, and how many masked rows kept a clear name or key."""
    names = ["customer", "orders", "lineitem"]
    tables = frames(t, names)
    rows = sub.extract(tables, keys_of(names), asia_subset(t))
    masked = mask_tables(rows, region_policy(), edges_of(names))
    clear = {
        "customer": F.col("c_name").startswith("Customer#"), "orders": F.date_trunc("DAY", "o_orderdate").isNull(),
        "lineitem": F.col("l_orderkey").isNull(),
    }
    parts = [
        masked[n].agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(clear[n].cast("int")), F.lit(0)).alias("unmasked"))
        .select(F.lit(n).alias("table_name"), "n_rows", "unmasked")
        for n in names
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "subset_and_mask_region",
    f"WITH c AS (SELECT customer.* {ASIA}), o AS (SELECT orders.*, c.c_name FROM orders JOIN c ON o_custkey = c_custkey) "
    f"SELECT {sql.first_name(KEY, 'name.first', 'c_name')} || ' ' || {sql.last_name(KEY, 'name.last', 'c_name')} AS customer_name, "
    "count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS line_items, "
    "CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS revenue "
    "FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def subset_and_mask_region(t):
    """Customers of one region with orders and line items, masked names, joined again through masked keys."""
    names = ["customer", "orders", "lineitem"]
    rows = sub.extract(frames(t, names), keys_of(names), asia_subset(t))
    keys = "TOKENIZE"
    policy = Policy(
        KEY,
        [
            Rule("customer", "c_name", "FULL_NAME"), Rule("customer", "c_custkey", keys), Rule("orders", "o_custkey", keys),
            Rule("orders", "o_orderkey", keys), Rule("lineitem", "l_orderkey", keys),
        ],
    )
    as_text = {
        "customer": rows["customer"].withColumn("c_custkey", F.col("c_custkey").cast("string")),
        "orders": rows["orders"].withColumns({c: F.col(c).cast("string") for c in ("o_custkey", "o_orderkey")}),
        "lineitem": rows["lineitem"].withColumn("l_orderkey", F.col("l_orderkey").cast("string")),
    }
    masked = mask_tables(as_text, policy, edges_of(names))
    items = masked["lineitem"].groupBy("l_orderkey").agg(
        F.count("*").alias("items"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("price")
    )
    return (
        masked["customer"].join(masked["orders"], F.col("c_custkey") == F.col("o_custkey"))
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy(F.col("c_name").alias("customer_name"))
        .agg(
            F.count("*").alias("orders"), F.coalesce(F.sum("items"), F.lit(0)).alias("line_items"),
            F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("revenue"),
        )
    )
