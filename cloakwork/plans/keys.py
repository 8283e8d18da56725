"""Key and foreign keys of the given tables; parquet carries none."""

from cloakwork.functions.keyed import MaskKey
from cloakwork.operators.subset import Edge

KEY = MaskKey("demo-masking-secret")

PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "documents": ["doc_id"],
    "labels": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
}
EDGES = [
    Edge("nation", "n_regionkey", "region", "r_regionkey"),
    Edge("customer", "c_nationkey", "nation", "n_nationkey"),
    Edge("supplier", "s_nationkey", "nation", "n_nationkey"),
    Edge("orders", "o_custkey", "customer", "c_custkey"),
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Edge("lineitem", "l_partkey", "part", "p_partkey"),
    Edge("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Edge("labels", "doc_id", "documents", "doc_id"),
]
