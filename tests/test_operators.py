import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import freetext, structured
from cloakwork.functions.generators import Source, Spec, generate
from cloakwork.operators import checks as chk
from cloakwork.operators import discovery as dis
from cloakwork.operators import entities as ent
from cloakwork.operators import loads
from cloakwork.operators import mapping as ops
from cloakwork.operators import positions as pos
from cloakwork.operators import subset as sub
from cloakwork.operators import synthesis as syn
from cloakwork.operators.policy import Clause, Policy, Rule, apply_policy, compare, key_salts, mask_tables
from cloakwork.operators.subset import Edge
from cloakwork.plans.mapping_plan import Link, MappingPlan, Source as PlanSource, run
from cloakwork.session import scratch_path
from cloakwork.sources import files
from cloakwork.sources import fixed_records as rec
from cloakwork.streaming import changes as chg
from cloakwork.streaming import snapshots as snap
from helpers import on_values


def test_sql_source_guard(spark):
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "UPDATE t SET a = 1"):
        with pytest.raises(ValueError):
            ops.sql_source(spark, bad)
    assert ops.sql_source(spark, "select 1 as a").first()["a"] == 1


def test_unlinked_source_meets_every_row(spark):
    big = spark.range(1500).withColumnRenamed("id", "b")
    assert ops.join_unlinked(spark.range(5), big).count() == 7500


def test_positions_with_one_hot_group(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 101, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r["id"]: r for r in pos.ranks(pos.ntile(pos.group_positions(df, ["g"], ["v", "id"]).drop("group_rows"), ["g"], ["v", "id"], 4), ["g"], "v").collect()}
    for g in ("hot", "cold"):
        ordered = sorted((v, i) for h, v, i in rows if h == g)
        size, extra = divmod(len(ordered), 4)
        tiles = [t + 1 for t in range(4) for _ in range(size + (t < extra))]
        values = sorted({v for v, _ in ordered})
        for n, (v, i) in enumerate(ordered):
            r = got[i]
            assert (r["row_number"], r["ntile"], r["dense_rank"]) == (n + 1, tiles[n], values.index(v) + 1)
            assert r["rank"] == 1 + sum(x < v for x, _ in ordered)


def test_sequence_has_no_gaps(spark):
    out = pos.with_sequence(spark.range(1000).repartition(6), [F.col("id").desc()])
    assert sorted((r["seq_no"], r["id"]) for r in out.collect()) == [(i + 1, 999 - i) for i in range(1000)]


def test_mapping_plan_order(tables):
    plan = MappingPlan(
        [PlanSource("o", tables.orders), PlanSource("c", tables.customer, "c_nationkey = 3")], [Link("o.o_custkey", "c.c_custkey")],
        expressions={"k": "o.o_orderkey", "p": "o.o_totalprice"}, sort=[("p", "DESC"), ("k", "ASC")], limit=3,
        staging=[[("key", "k", "string"), ("gap", None, "int")]],
    )
    out = run(plan).collect()
    assert len(out) == 3 and out[0]["gap"] is None and isinstance(out[0]["key"], str)


def test_closure_follows_a_cycle_and_stops(spark):
    people = spark.createDataFrame([(i, (i * 3) % 10) for i in range(30)], "id int, boss int")
    edges = [Edge("p", "boss", "p", "id")]
    found = sub.plan_subset({"p": people}, {"p": ["id"]}, edges, "p", "id = 1")
    want, fresh = {1}, {1}
    while fresh:
        more = {i for i in range(30) if (i * 3) % 10 in fresh} | {(i * 3) % 10 for i in fresh}
        fresh = more - want
        want |= fresh
    assert {r["id"] for r in found.keys["p"].collect()} == want and not found.warnings


def test_closure_through_a_non_key_parent_column(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, code string")
    kids = spark.createDataFrame([(10, "a"), (11, "b"), (12, None)], "kid int, code string")
    edges = [Edge("k", "code", "p", "code")]
    keys = {"p": ["id"], "k": ["kid"]}
    found = sub.plan_subset({"p": parents, "k": kids}, keys, edges, "p", "id = 1")
    assert {r["kid"] for r in found.keys["k"].collect()} == {10}
    up = sub.plan_subset({"p": parents, "k": kids}, keys, edges, "k", "kid = 11", children=False)
    assert {r["id"] for r in up.keys["p"].collect()} == {2}


def test_load_order_puts_parents_first():
    edges = [Edge("l", "o", "o", "o"), Edge("o", "c", "c", "c")]
    assert sub.referenced_first(["l", "o", "c"], edges) == ["c", "o", "l"]


def test_key_salts_join_chains():
    salts = key_salts([Edge("b", "x", "a", "id"), Edge("c", "y", "b", "x"), Edge("d", "z", "e", "q")])
    assert salts[("c", "y")] == salts[("a", "id")] == "ri:a.id" and salts[("d", "z")] == "ri:d.z"


def test_masked_keys_still_join(tables, key):
    rules = [Rule("customer", "c_custkey", "FORMAT_PRESERVE"), Rule("orders", "o_custkey", "FORMAT_PRESERVE")]
    frames = {
        "customer": tables.customer.select(F.col("c_custkey").cast("string").alias("c_custkey")),
        "orders": tables.orders.select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderkey"),
    }
    edges = [Edge("orders", "o_custkey", "customer", "c_custkey")]
    out = mask_tables(frames, Policy(key, rules), edges)
    clear = frames["orders"].join(frames["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_semi").count()
    assert out["orders"].join(out["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_semi").count() == clear


@pytest.mark.parametrize(
    "op, value, expected, want",
    [
        ("EQ", " Ab ", "aB", True), ("NE", None, "x", True), ("NOT_IN", None, "x", True), ("IN", "b", "A, B", True), ("GT", "10", "9", True),
        ("LT", "abc", "abd", True), ("CONTAINS", "xYz", "y", True), ("STARTS_WITH", "xYz", "y", False), ("IS_NULL", "", None, True),
        ("IS_NOT_NULL", None, None, False), ("EQ", None, "x", False), ("GTE", "9", "9", True), ("LTE", "x", "9", False),
    ],
)
def test_clauses(spark, op, value, expected, want):
    assert on_values(spark, [value], lambda v: compare(v, op, expected)) == [want]


def test_conditional_rule_on_joined_table(spark, key):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    other = spark.createDataFrame([(" 1", "VIP"), ("2 ", "std"), ("2", "std")], "k string, tier string")
    rule = Rule("t", "v", "FIXED", p1="-", clauses=(Clause("tier", "EQ", "vip", "o", "id", "k"),))
    out = apply_policy(rows, "t", Policy(key, [rule]), {"o": other})
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "-"), (2, "b"), (3, "c")]


def test_free_text_rules(spark, key):
    texts = [
        "Hello, my name is Jane Doe, ssn 123456789 and mail jane@corp.com!", "card 4111-1111-1111-1111 not 4111-1111-1111-1112",
        "call (415) 555-2671 from 10.1.2.3 or 00:1A:2B:3C:4D:5E", "IBAN GB82WEST12345698765432.", "nothing here", None, "",
    ]
    out = on_values(spark, texts, lambda v: freetext.masked_text(v, key))
    assert "Jane" not in out[0] and "123456789" not in out[0] and "corp.com" not in out[0] and out[0].startswith("Hello, my name is ")
    assert "4111-1111-1111-1111" not in out[1] and "4111-1111-1111-1112" in out[1]
    assert "10.1.2.3" not in out[2] and "555-01" in out[2] and "1A:2B" not in out[2]
    assert "WEST" not in out[3] and out[3].startswith("IBAN GB")
    assert out[4:] == ["nothing here", None, ""]
    counts = on_values(spark, texts[:2], lambda v: freetext.counts_by_kind(freetext.mask_text(v, key)["found"]))
    # The masked number is written with dashes, so the later dashed rule masks it once more.
    assert counts == [{"FULL_NAME": 1, "SSN": 2, "EMAIL": 1}, {"CREDIT_CARD": 1}]


def test_markup_keeps_tags(spark, key):
    change = lambda x: F.upper(x)
    html = '<p class="a">hi <b>you</b></p><script>var a = "x<y";</script><!-- note --> end'
    assert on_values(spark, [html], lambda v: structured.change_html_text(v, change)) == [
        '<p class="a">HI <b>YOU</b></p><script>var a = "x<y";</script><!-- note --> END'
    ]
    xml = '<?xml version="1.0"?><a k="v"><b/>t</a>'
    assert on_values(spark, [xml], lambda v: structured.change_xml_text(v, change)) == ['<?xml version="1.0"?><a k="V"><b/>T</a>']
    doc = '{"a": "x", "b": ["y", {"c": "z\\"q"}], "n": 1}'
    assert on_values(spark, [doc], lambda v: structured.change_json_text(v, change)) == ['{"a": "X", "b": ["Y", {"c": "Z\\"Q"}], "n": 1}']
    assert on_values(spark, [doc], lambda v: structured.change_json_text(v, change, ["c"])) == ['{"a": "x", "b": ["y", {"c": "Z\\"Q"}], "n": 1}']


def test_discovery_prefers_data_over_name(spark):
    df = spark.createDataFrame([(f"u{i}@corp.com", "x") for i in range(10)], "phone string, note string")
    row = dis.findings(dis.column_scores({"t": df})).collect()
    assert [(r["column_name"], r["pii_type"], r["confidence"]) for r in row] == [("phone", "EMAIL", 0.7)]


@pytest.mark.parametrize(
    "kind, value, real",
    [
        ("SSN", "123-45-6789", True), ("SSN", "000-12-3456", False), ("SSN", "999-12-3456", False), ("SSN", "***-**-6789", False),
        ("CREDIT_CARD", "4111111111111111", True), ("CREDIT_CARD", "0000000000000000", False), ("EMAIL", "a@corp.com", True),
        ("EMAIL", "a@x.test", False), ("EMAIL", "a@example.com", False), ("PHONE", "(415) 867-5309", True), ("PHONE", "(415) 555-0100", False),
        ("ROUTING", "021000021", True), ("ROUTING", "021000022", False), ("IBAN", "DE89370400440532013000", True), ("COLOR", "red", False),
    ],
)
def test_real_world_validity(spark, kind, value, real):
    assert on_values(spark, [value], lambda v: chk.looks_real(kind, v)) == [real]


def netted(changes):
    """Sequential netting of (id, key, op, values)."""
    state = {}
    for _, k, op, values in sorted(changes):
        if op == "D":
            state[k] = ("D", {})
        else:
            before_op, before = state.get(k, (None, {}))
            merged = {} if before_op == "D" else dict(before)
            merged.update(values)
            state[k] = ("I" if before_op == "I" or op == "I" else op, {"id": k, **merged})
    return state


def test_netting_against_a_sequential_walk(spark):
    rng = random.Random(5)
    changes = []
    for i in range(600):
        op = rng.choice("IUUUD")
        values = {} if op == "D" else {c: rng.choice([None, str(rng.randint(0, 9))]) for c in rng.sample("abc", rng.randint(0, 3))}
        changes.append((i, str(rng.randint(0, 25) if i % 3 else 7), op, values))
    rows = [(i, "t", op, {"id": k}, v, dt.datetime(2024, 1, 1)) for i, k, op, v in changes]
    rng.shuffle(rows)
    feed = spark.createDataFrame(rows, chg.FEED).repartition(5)
    got = {r["pk"]["id"]: (r["op"], r["values"]) for r in chg.net_changes(feed).collect()}
    want = netted(changes)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    stored = chg.cells(feed.where("id % 2 = 0")).unionByName(chg.cells(feed.where("id % 2 = 1")))
    assert {r["pk"]["id"]: (r["op"], r["values"]) for r in chg.net(chg.merge_cells(stored)).collect()} == got


def test_apply_tells_null_from_absent(spark):
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "id int, x string, y string")
    rows = [(1, "t", "U", {"id": "1"}, {"x": None}, None), (2, "t", "D", {"id": "2"}, None, None), (3, "t", "D", {"id": "3"}, None, None), (4, "t", "I", {"id": "3"}, {"x": "n"}, None)]
    out = chg.replay(target, spark.createDataFrame(rows, chg.FEED), "t", ["id"])
    assert sorted((r["id"], r["x"], r["y"]) for r in out.collect()) == [(1, None, "b"), (3, "n", None)]


def test_repeated_stream_batch_changes_nothing(spark):
    target = spark.createDataFrame([(1, "a")], "id int, x string")
    path = scratch_path(spark, "cells")
    feed = spark.createDataFrame([(1, "t", "U", {"id": "1"}, {"x": "b"}, None), (2, "t", "I", {"id": "2"}, {"x": "c"}, None)], chg.FEED)
    write = chg.store_cells(path)
    write(feed, 0)
    once = sorted(map(tuple, chg.current(target, path, "t", ["id"]).collect()))
    write(feed, 0)
    assert sorted(map(tuple, chg.current(target, path, "t", ["id"]).collect())) == once == [(1, "b"), (2, "c")]


def test_snapshot_without_key_is_refused(spark):
    store = scratch_path(spark, "snap")
    snap.take(spark.createDataFrame([(1, "a")], "id int, x string"), "t", ["id"], 4, store, "one")
    feed = spark.createDataFrame([(1, "t", "U", {}, {"x": "b"}, None)], chg.FEED)
    with pytest.raises(ValueError):
        snap.advance(spark, store, "t", ["id"], "one", "two", feed)


def test_generated_values_do_not_depend_on_layout(spark, key):
    source = Source(key, "t.c")
    for name, p1 in (("EMAIL", None), ("CREDIT_CARD_VISA", None), ("WEIGHTED", "A:3|B:1"), ("NORMAL_INT", "10")):
        frames = [
            sorted(map(tuple, spark.range(1, 301).repartition(n).select("id", generate(Spec(name, p1, "2"), source, F.col("id")).alias("v")).collect()))
            for n in (1, 7, 32)
        ]
        assert frames[0] == frames[1] == frames[2]


@pytest.mark.parametrize(
    "text, want",
    [
        ("CHECK (status IN ('A', 'B'))", ("status", syn.Check(values=("A", "B")))), ("risk BETWEEN 0 AND 100", ("risk", syn.Check(low="0", high="100"))),
        ("balance >= 0", ("balance", syn.Check(low="0"))), ("rate > 0.00", ("rate", syn.Check(low="0.01"))), ("a < b", None), ("length(x) > 3 OR y = 1", None),
    ],
)
def test_checks_from_text(text, want):
    assert syn.check_of(text) == want


def test_infeasible_plans_fail(spark):
    parents = syn.Table("p", 3, [syn.Col("id", "SEQUENCE")])
    with pytest.raises(ValueError):
        syn.Generator(spark, [parents, syn.Table("c", 10, [syn.Col("p", refers=("p", "id"), fewest=0, most=3)])])
    with pytest.raises(ValueError):
        syn.Generator(spark, [syn.Table("big", 10**13, [syn.Col("n", "CREDIT_CARD_DINERS"), ])])


def test_unique_emails_keep_their_shape(spark):
    df = spark.createDataFrame([(1, "a@x.test"), (2, "a@x.test"), (3, "b"), (4, "b"), (5, None), (6, "c")], "_row long, v string")
    assert {r["_row"]: r["v"] for r in syn.made_unique(df, "v").collect()} == {1: "a@x.test", 2: "a+2@x.test", 3: "b", 4: "b-4", 5: None, 6: "c"}


def test_fixed_records_round_trip(spark):
    fields = [rec.FieldAt("t", 1, 6), rec.FieldAt("z", 7, 4, "ZONED"), rec.FieldAt("p", 11, 4, "PACKED", 2), rec.FieldAt("b", 15, 2, "BINARY")]
    df = spark.createDataFrame([("Ab1", -12, "-123.45", -7), ("", 9999, "0.01", 32000), ("too long", 0, "99999.99", -32768)], "t string, z int, p string, b int")
    out = rec.decode(rec.encode(df, fields, 16), fields).collect()
    assert [(r["t"], r["z"], str(r["p"]), r["b"]) for r in out] == [("Ab1", -12, "-123.45", -7), ("", 9999, "0.01", 32000), ("too lo", 0, "99999.99", -32768)]
    raw = rec.encode(df.limit(1), fields, 16).first()["record"]
    assert bytes(raw) == "Ab1   ".encode("cp037") + bytes.fromhex("F0F0F1D2") + bytes.fromhex("0012345D") + (-7).to_bytes(2, "big", signed=True)
    with pytest.raises(Exception, match="does not fit"):
        rec.encode(spark.createDataFrame([("x", 12345, "0", 0)], "t string, z int, p string, b int"), fields, 16).collect()


def test_fit_refuses_loss(spark):
    from pyspark.sql import types as T

    assert on_values(spark, ["abcdef"], lambda v: loads.fit(v, T.StringType(), 3)) == ["abc"]
    for kind, bad in ((T.DecimalType(5, 2), "1.234"), (T.BooleanType(), "maybe")):
        with pytest.raises(Exception):
            on_values(spark, [bad], lambda v: loads.fit(v, kind))


def test_reject_gate(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    fitted = loads.split_rejects(df, {"n": "int"})
    assert loads.check_rejects(fitted, 1) == 1 and fitted.good.count() == 2
    with pytest.raises(ValueError):
        loads.check_rejects(fitted, 0)


def test_infer_types_widens_on_conflict(spark):
    df = spark.createDataFrame([("1", "true", None, "2024-01-01", "1"), ("2.5", "FALSE", None, "2024-02-30", "x")], "a string, b string, c string, d string, e string")
    assert {r["column_name"]: r["inferred"] for r in files.infer_types(df).collect()} == {"a": "NUMBER", "b": "BOOLEAN", "c": "UNKNOWN", "d": "STRING", "e": "STRING"}


def test_audit_chain_finds_tampering(spark):
    import base64
    import hashlib

    rows, previous = [], ""
    for i in range(20):
        digest = base64.b64encode(hashlib.sha256(f"{previous}|{i}|act{i}".encode()).digest()).decode()
        rows.append([i, f"act{i}", previous, digest])
        previous = digest
    schema = "seq long, action string, prev_hash string, hash string"
    assert chk.verify_chain(spark.createDataFrame(rows, schema), "seq", ["seq", "action"]).count() == 0
    rows[5][1] = "forged"
    del rows[12]
    broken = chk.verify_chain(spark.createDataFrame(rows, schema), "seq", ["seq", "action"]).collect()
    assert {(r["seq"], r["reason"]) for r in broken} == {(5, "CONTENT_MISMATCH"), (13, "LINK_BREAK")}


def test_fragments_hold_every_row_of_a_hot_entity(spark):
    rows = spark.range(500).select((F.when(F.col("id") < 400, 1).otherwise(F.col("id"))).alias("owner"), F.col("id").alias("item"))
    parts = ent.fragments([ent.Member("items", rows, "owner")], 50)
    hot = parts.where("entity = 1")
    assert hot.count() > 4 and hot.agg(F.sum("n_rows")).first()[0] == 400
    assert ent.capsule(parts).agg(F.sum("n_rows")).first()[0] == 500
    same = spark.range(130).select(F.lit(1).alias("owner"), F.lit("equal").alias("item"))  # one hash, so cut by position
    cut = ent.fragments([ent.Member("items", same, "owner")], 50).collect()
    assert sorted(r["n_rows"] for r in cut) == [30, 50, 50] and len({r["part"] for r in cut}) == 3


def test_reservation_needs_enough_free_keys(spark, tables):
    none = spark.createDataFrame([], "entity long, holder string, status string, expires_at timestamp_ntz")
    with pytest.raises(ValueError):
        ent.reserve(tables.customer, "c_custkey", "c_custkey < 3", 10, none, dt.datetime(2024, 1, 1), "me", dt.datetime(2024, 2, 1))


def test_text_counts_against_brute_force(spark, tables, key):
    """Whole documents: masked e-mails, addresses and cards equal a plain walk over the same texts."""
    import re

    def luhn(text):
        digits = [int(c) for c in reversed(re.sub("[ -]", "", text))]
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0

    texts = [r["text"] for r in tables.documents.select("text").collect()]
    rules = {r.kind: r for r in freetext.DEFAULT_RULES if r.kind in ("EMAIL", "IP_ADDRESS", "CREDIT_CARD")}
    want = {k: sum(len(re.findall(r.pattern, x, re.I)) for x in texts) for k, r in rules.items() if k != "CREDIT_CARD"}
    want["CREDIT_CARD"] = sum(luhn(m) for x in texts for m in re.findall(rules["CREDIT_CARD"].pattern, x))
    done = tables.documents.select(freetext.mask_text(F.col("text"), key).alias("r"))
    counts = done.select(F.explode(freetext.counts_by_kind(F.col("r.found"))).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    got = {r["k"]: r["n"] for r in counts.collect()}
    assert {k: got.get(k, 0) for k in want} == want


def test_closure_follows_a_chain_to_its_end(spark):
    """Deeper than any number of passes that the count of tables and keys suggests."""
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(15)], "id int, boss int").coalesce(1)
    found = sub.plan_subset({"chain": chain}, {"chain": ["id"]}, [Edge("chain", "boss", "chain", "id")], "chain", where="id = 0", parents=False)
    assert found.counts["chain"] == 15


def test_markup_masks_reach_the_end_of_long_texts(spark, key):
    """Eight thousand characters in one JSON string: read back, they are the mask of the plain text to its end."""
    from cloakwork.functions import structured
    from cloakwork.functions.masks import mask

    change = lambda x: mask("FORMAT_PRESERVE", x, key, "w")
    text = "Word 17 \"q\" \\ & <b> 'é\n" * 320
    row = spark.createDataFrame([(text,)], "x string").repartition(1).withColumn("want", change(F.col("x")))
    back = F.get_json_object(structured.change_json_text(F.to_json(F.struct("x")), change), "$.x")
    got = row.select("want", back.alias("back")).first()
    assert got["back"] == got["want"] and len(got["want"]) == len(text) and got["want"][-30:] != text[-30:]
