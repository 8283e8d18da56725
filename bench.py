"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "aggregate_named", "federated_mapping_report", "join_inner", "top_rows_in_group", "rank_all_rows_in_group", "sequence_number",
    "subset_and_mask_region", "subset_children_closure", "mask_first_name", "mask_tokenize", "mask_date_shift",
    "mask_format_preserve", "mask_credit_card_keep_bin", "policy_key_salt_join", "policy_shared_date_shift", "text_mask_documents",
    "text_mask_html", "discover_all_tables", "profile_columns", "check_leak_by_hash", "check_cardinality_collapse",
    "generate_relational_evidence", "generate_unique_cards", "change_net_per_key", "change_stream_apply", "snapshot_manifest",
    "entity_assemble_all_keys", "load_upsert",
]


def main() -> None:
    from cloakwork.plans import load_queries
    from cloakwork.session import get_spark

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cpus, os.environ.get("BENCH_MEMORY", "16g"))
    queries, _ = load_queries()
    seconds = {}
    queries["join_inner"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
