"""Mapping operators over whole tables."""

from pyspark.sql import functions as F

from cloakwork.operators import mapping as ops
from cloakwork.operators import positions as pos
from cloakwork.plans.keys import KEY
from cloakwork.plans import sqltext as sql
from cloakwork.plans.mapping_plan import Link, MappingPlan, Source, run
from cloakwork.plans.registry import query

MONEY = "decimal(14,2)"


@query(
    "filter_rows",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity > 30",
)
def filter_rows(t):
    kept = ops.scan(t.lineitem, "l_shipdate < timestamp_ntz'1997-01-01' AND l_quantity > 30")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "project_expressions",
    "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS net, "
    "l_returnflag || '-' || l_linestatus AS flags FROM lineitem",
)
def project_expressions(t):
    return run(
        MappingPlan(
            [Source("l", t.lineitem)],
            expressions={
                "l_orderkey": "l.l_orderkey",
                "l_linenumber": "l.l_linenumber",
                "net": "cast(round(cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(4,2))), 2) as double)",
                "flags": "l_returnflag || '-' || l_linestatus",
            },
        )
    )


@query(
    "map_copy_literal_mask_unused",
    f"SELECT c_custkey AS id, 'TEST' AS system, {sql.first_name(KEY, 'name.first', 'c_name')} AS given_name FROM customer",
)
def map_actions(t):
    return ops.map_columns(
        t.customer,
        [
            ops.ColumnMap("id", "COPY", "c_custkey"),
            ops.ColumnMap("system", "LITERAL", literal="TEST"),
            ops.ColumnMap("given_name", "MASK", "c_name", function="FIRST_NAME"),
            ops.ColumnMap("c_acctbal", "UNUSED"),
        ],
        KEY,
    )


@query(
    "join_inner",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def join_inner(t):
    plan = MappingPlan(
        [Source("o", t.orders), Source("c", t.customer)],
        [Link("o.o_custkey", "c.c_custkey")],
        expressions={"o_orderkey": "o.o_orderkey", "c_name": "c.c_name", "o_totalprice": "o.o_totalprice"},
    )
    return run(plan)


@query(
    "join_composite_key",
    "SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM lineitem WHERE l_returnflag = 'R') b "
    "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey",
)
def join_composite(t):
    columns = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
    returned = t.lineitem.where("l_returnflag = 'R'").select(*columns).distinct()
    plan = MappingPlan(
        [Source("a", t.lineitem.select(*columns)), Source("b", returned)],
        [
            Link("a.l_orderkey", "b.l_orderkey"), Link("b.l_linenumber", "a.l_linenumber"),
            Link("a.l_partkey", "b.l_partkey"),
        ],
        expressions={"l_orderkey": "a.l_orderkey", "l_linenumber": "a.l_linenumber", "l_tax": "b.l_tax"},
    )
    return run(plan)


for how, word in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    @query(
        f"join_{how}",
        f"SELECT doc_id_d, doc_id_l, quality FROM (SELECT doc_id AS doc_id_d FROM documents WHERE lang = 'en') d "
        f"{word} JOIN (SELECT doc_id AS doc_id_l, quality FROM labels) l ON doc_id_d = doc_id_l",
    )
    def join_outer(t, how=how):
        docs = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("doc_id_d"))
        labels = t.labels.select(F.col("doc_id").alias("doc_id_l"), "quality")
        return ops.join_on(docs, labels, [("doc_id_d", "doc_id_l")], how)


@query(
    "join_unlinked_small_source",
    "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region",
)
def join_unlinked(t):
    return run(
        MappingPlan(
            [Source("s", t.supplier), Source("r", t.region)],
            expressions={"s_suppkey": "s.s_suppkey", "r_name": "r.r_name"},
        )
    )


@query(
    "join_self_by_alias",
    "SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey + 5 = b.n_nationkey",
)
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    out = ops.join_on(a, b, [("a.n_regionkey", "b.n_regionkey"), ("a.n_nationkey + 5", "b.n_nationkey")])
    return out.select(F.col("a.n_name").alias("nation"), F.col("b.n_name").alias("neighbour"))


@query(
    "join_across_systems_as_text",
    "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON trim(CAST(o_custkey AS VARCHAR)) = trim(CAST(c_custkey AS VARCHAR))",
)
def join_text(t):
    foreign = t.customer.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit("  ")).alias("ref"), "c_mktsegment")
    return ops.join_as_text(t.orders, foreign, [("o_custkey", "ref")]).select("o_orderkey", "c_mktsegment")


@query(
    "lookup_reference",
    "SELECT s_suppkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def lookup_reference(t):
    found = ops.look_up(t.supplier.select("s_suppkey", "s_nationkey"), t.nation, "s_nationkey = n_nationkey", ["n_name", "n_regionkey"])
    return found.drop("s_nationkey")


@query(
    "aggregate_named",
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS sum_qty, "
    "CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS sum_price, count(*) AS n_rows, max(l_shipdate) AS last_ship "
    "FROM lineitem GROUP BY ALL",
)
def aggregate_named(t):
    plan = MappingPlan(
        [Source("l", t.lineitem)],
        aggregates=(
            ["l_returnflag", "l_linestatus"],
            {
                "sum_qty": f"cast(sum(cast(l_quantity as {MONEY})) as double)",
                "sum_price": f"cast(sum(cast(l_extendedprice as {MONEY})) as double)",
                "n_rows": "count(*)",
                "last_ship": "max(l_shipdate)",
            },
        ),
    )
    return run(plan)


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return run(
        MappingPlan(
            [Source("o", t.orders)],
            expressions={"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}, distinct=True,
        )
    )


@query(
    "pivot_values",
    "SELECT p_type, sum(CASE WHEN p_brand = 'Brand#1' THEN p_size END) AS \"Brand#1\", "
    "sum(CASE WHEN p_brand = 'Brand#2' THEN p_size END) AS \"Brand#2\" FROM part GROUP BY p_type",
)
def pivot_values(t):
    return run(
        MappingPlan(
            [Source("p", t.part)],
            pivot={"group": ["p_type"], "category": "p_brand", "value": "p_size", "values": ["Brand#1", "Brand#2"]},
        )
    )


@query(
    "union_all_with_condition",
    "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 0",
)
def union_all(t):
    base = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return ops.union(base, t.supplier.where("s_acctbal > 0").select("s_name", "s_acctbal"))


@query("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return ops.union(t.customer.select(F.col("c_nationkey").alias("nationkey")), t.supplier.select("s_nationkey"), False)


@query(
    "top_rows_in_group",
    "SELECT o_custkey, o_orderkey, rank_in_group FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group FROM orders) WHERE rank_in_group <= 3",
)
def top_rows(t):
    plan = MappingPlan(
        [Source("o", t.orders)],
        expressions={"o_custkey": "o_custkey", "o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"},
        rank={"group": ["o_custkey"], "order": [F.col("o_totalprice").desc(), F.col("o_orderkey")], "top": 3},
    )
    return run(plan).drop("o_totalprice")


@query(
    "rank_all_rows_in_group",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank_in_group FROM events",
)
def rank_all(t):
    plan = MappingPlan(
        [Source("e", t.events)],
        expressions={"event_id": "event_id", "event_type": "event_type", "value": "value"},
        rank={"group": ["event_type"], "order": ["value", "event_id"]},
    )
    return run(plan).select("event_id", "rank_in_group")


@query(
    "sequence_number",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq_no FROM orders",
)
def sequence_number(t):
    return ops.sequence(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "sort_keys",
    "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name",
)
def sort_keys(t):
    plan = MappingPlan(
        [Source("n", t.nation)], expressions={"n_regionkey": "n_regionkey", "n_name": "n_name"},
        sort=[("n_regionkey", "DESC"), ("n_name", "ASC")],
    )
    return run(plan)


@query(
    "limit_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def limit_rows(t):
    plan = MappingPlan(
        [Source("o", t.orders)], expressions={"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice"},
        sort=[("o_totalprice", "DESC"), ("o_orderkey", "ASC")], limit=25,
    )
    return run(plan)


@query("route_active", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def route_active(t):
    plan = MappingPlan(
        [Source("o", t.orders)], routes={"open": "o_orderstatus = 'O'", "filled": "o_orderstatus = 'F'"},
        active_route="filled", expressions={"o_orderkey": "o_orderkey"},
    )
    return run(plan)


@query(
    "stage_with_casts",
    "SELECT CAST(p_partkey AS VARCHAR) AS part_ref, CAST(p_retailprice AS DECIMAL(10,1))::DOUBLE AS price, CAST(NULL AS VARCHAR) AS memo FROM part",
)
def stage_with_casts(t):
    plan = MappingPlan(
        [Source("p", t.part)],
        staging=[[("part_ref", "p_partkey", "string"), ("price", "p_retailprice", "decimal(10,1)"), ("memo", None, "string")]],
    )
    return run(plan).withColumn("price", F.col("price").cast("double"))


@query(
    "semi_join_keys",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def semi_join(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ops.keep_keys(t.orders, keys, ["o_custkey"]).select("o_orderkey")


@query(
    "anti_join_trim",
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def anti_join(t):
    return ops.drop_keys(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"])


@query(
    "federated_mapping_report",
    "SELECT r_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE o_orderstatus <> 'P' GROUP BY ALL",
)
def mapping_report(t):
    plan = MappingPlan(
        [
            Source("o", t.orders, "o_orderstatus <> 'P'"), Source("c", t.customer), Source("n", t.nation),
            Source("r", t.region),
        ],
        [
            Link("o.o_custkey", "c.c_custkey"), Link("c.c_nationkey", "n.n_nationkey"),
            Link("n.n_regionkey", "r.r_regionkey"),
        ],
        aggregates=(
            ["r.r_name", "c.c_mktsegment"],
            {"orders": "count(*)", "total": f"cast(sum(cast(o_totalprice as {MONEY})) as double)"},
        ),
    )
    return run(plan)
