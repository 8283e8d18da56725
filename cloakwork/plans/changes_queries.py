"""Change feeds and snapshots; the feed is derived from the events table."""

import datetime as dt

from pyspark.sql import functions as F

from cloakwork.functions.masks import mask
from cloakwork.plans import sqltext as sql
from cloakwork.plans.keys import KEY
from cloakwork.plans.registry import query
from cloakwork.session import scratch_path
from cloakwork.streaming import changes as chg
from cloakwork.streaming import snapshots as snap
from cloakwork.streaming.live import LiveTable

K = "regexp_extract(props, '[0-9]+', 0)"


def feed(t):
    """signup = insert, error = delete, the rest are partial updates; a small k becomes null."""
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    k = F.regexp_extract("props", "[0-9]+", 0)
    k = F.when(k.cast("int") >= 10, k)
    empty = F.create_map().cast("map<string,string>")
    values = (
        F.when(F.col("event_type") == "view", F.create_map(F.lit("amount"), amount))
        .when(F.col("event_type") == "click", F.create_map(F.lit("k"), k))
        .when(F.col("event_type") == "error", empty)
        .otherwise(F.create_map(F.lit("amount"), amount, F.lit("k"), k))
    )
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "error", "D").otherwise("U")
    keyed = F.when(F.col("event_id") % 50 == 49, empty).otherwise(F.create_map(F.lit("user_id"), F.col("user_id").cast("string")))
    table = F.when(F.col("user_id") % 3 == 0, "accounts").otherwise("users")
    return t.events.select(
        F.col("event_id").alias("id"), table.alias("table_name"), op.alias("op"), keyed.alias("pk"), values.alias("values"),
        F.col("ts").alias("captured_at"),
    )


FEED = (
    "WITH feed AS (SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'accounts' ELSE 'users' END AS table_name, user_id, ts, "
    "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, "
    "event_type IN ('view', 'purchase', 'signup') AS has_amount, event_type IN ('click', 'purchase', 'signup') AS has_k, "
    "value::DECIMAL(12,2)::VARCHAR AS amount, CASE WHEN regexp_extract(props, '[0-9]+')::INT >= 10 THEN regexp_extract(props, '[0-9]+') END AS k "
    "FROM events WHERE event_id % 50 <> 49 {where}), "
    "dels AS (SELECT table_name, user_id, coalesce(max(id) FILTER (op = 'D'), -1) AS d, max(id) AS last_id, max_by(op, id) AS last_op FROM feed GROUP BY ALL), "
    "live AS (SELECT f.*, d, last_id, last_op FROM feed f JOIN dels USING (table_name, user_id)), "
    "netted AS (SELECT table_name, user_id, last_id, CASE WHEN any_value(last_op) = 'D' THEN 'D' WHEN max(id) FILTER (op = 'I') > any_value(d) THEN 'I' ELSE 'U' END AS op, "
    "any_value(d) AS d, (arg_max(struct_pack(v := amount), id) FILTER (has_amount AND id > d)).v AS amount, count(*) FILTER (has_amount AND id > d) > 0 AS has_amount, "
    "(arg_max(struct_pack(v := k), id) FILTER (has_k AND id > d)).v AS k, count(*) FILTER (has_k AND id > d) > 0 AS has_k FROM live GROUP BY ALL) "
)
NETTED = "SELECT table_name, user_id, op, last_id, amount, has_amount, k, has_k FROM netted"


def flat(netted):
    v = F.col("values")
    return netted.select(
        "table_name", F.col("pk")["user_id"].cast("bigint").alias("user_id"), "op", "last_id", F.try_element_at(v, F.lit("amount")).alias("amount"),
        F.map_contains_key(v, F.lit("amount")).alias("has_amount"), F.try_element_at(v, F.lit("k")).alias("k"), F.map_contains_key(v, F.lit("k")).alias("has_k"),
    )


@query("change_net_per_key", FEED.format(where="") + NETTED)
def netting(t):
    return flat(chg.net_changes(feed(t)))


@query("change_scope_filter", "SELECT event_id AS id, 'users' AS table_name FROM events WHERE user_id % 3 <> 0")
def scope(t):
    return chg.in_scope(feed(t), ["USERS"]).select("id", "table_name")


@query(
    "change_skip_without_key",
    "SELECT CASE WHEN user_id % 3 = 0 THEN 'accounts' ELSE 'users' END AS table_name, count(*) AS skipped FROM events WHERE event_id % 50 = 49 GROUP BY 1",
)
def keyless(t):
    return chg.without_key(feed(t))


BASE = "base AS (SELECT DISTINCT user_id, '0.00' AS amount, '1' AS k FROM events WHERE user_id % 3 <> 0 AND user_id % 2 = 0) "
APPLIED = (
    "SELECT coalesce(b.user_id, n.user_id) AS user_id, "
    "CASE WHEN n.user_id IS NULL THEN b.amount WHEN has_amount THEN n.amount WHEN d < 0 THEN b.amount END AS amount, "
    "CASE WHEN n.user_id IS NULL THEN b.k WHEN has_k THEN n.k WHEN d < 0 THEN b.k END AS k "
    "FROM base b FULL JOIN (SELECT * FROM netted WHERE table_name = 'users') n ON b.user_id = n.user_id WHERE n.op IS NULL OR n.op <> 'D'"
)


def base(t):
    users = t.events.where("user_id % 3 <> 0 AND user_id % 2 = 0").select("user_id").distinct()
    return users.select("user_id", F.lit("0.00").alias("amount"), F.lit("1").alias("k"))


@query("change_apply_upsert_delete", FEED.format(where="").rstrip() + ", " + BASE + APPLIED)
def applied(t):
    return chg.apply_net(base(t), chg.net_changes(feed(t)), "users", ["user_id"])


@query(
    "change_replay_as_of",
    FEED.format(where="AND event_id <= 4000 AND ts <= TIMESTAMP '2024-01-08 00:00:00'").rstrip() + ", " + BASE + APPLIED,
)
def replayed(t):
    return chg.replay(base(t), feed(t), "users", ["user_id"], 4000, dt.datetime(2024, 1, 8))


@query("change_stream_apply", FEED.format(where="").rstrip() + ", " + BASE + APPLIED)
def streamed(t):
    """The feed arrives as files, out of order, in micro-batches; the result equals the batch replay."""
    source, store, mark = (scratch_path(t.spark, x) for x in ("feed", "cells", "position"))
    feed(t).repartition(4, F.sha2(F.col("id").cast("string"), 256)).write.json(source)
    stream = chg.in_scope(chg.feed_stream(t.spark, source, files=1), ["users"])
    chg.run_available(stream, chg.store_cells(store), mark)
    return chg.current(base(t), store, "users", ["user_id"])


@query("change_continuous_apply", FEED.format(where="").rstrip() + ", " + BASE + APPLIED)
def continuous(t):
    """A live target takes the feed in micro-batches, out of order; then all changes of odd ids come once more."""
    source, root, mark = (scratch_path(t.spark, x) for x in ("feed", "live", "position"))
    feed(t).repartition(4, F.sha2(F.col("id").cast("string"), 256)).write.json(source)
    table = LiveTable(t.spark, root, "users", ["user_id"], buckets=8, deltas=2)
    table.create(base(t))
    chg.run_available(chg.feed_stream(t.spark, source, files=1), table.sink(), mark)
    table.apply(feed(t).where("id % 2 = 1"))
    return table.read()


@query(
    "change_stream_mask",
    f"SELECT event_id, 'TKN_' || substr({sql.digest(KEY, 'user|token', 'user_id::VARCHAR')}, 1, 32) AS user_token, event_type FROM events",
)
def stream_mask(t):
    """Rows masked as they arrive; stateless, the same expressions as in batch."""
    out, mark = scratch_path(t.spark, "masked"), scratch_path(t.spark, "position")
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    masked = source.select("event_id", mask("TOKENIZE", F.col("user_id"), KEY, "user").alias("user_token"), "event_type")
    masked.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


NOW = dt.datetime(2024, 2, 1)


@query(
    "change_freshness",
    "WITH m AS (SELECT 'events' AS member, max(ts) AS newest FROM events UNION ALL SELECT 'orders', max(o_orderdate) FROM orders UNION ALL SELECT 'parts', NULL) "
    "SELECT member, newest, greatest(0, date_sub('second', newest, TIMESTAMP '2024-02-01')) AS lag_seconds, "
    "CASE WHEN newest IS NULL THEN 'UNKNOWN' WHEN greatest(0, date_sub('second', newest, TIMESTAMP '2024-02-01')) <= 1000000 THEN 'FRESH' ELSE 'STALE' END AS status FROM m",
)
def fresh(t):
    out = chg.freshness({"events": (t.events, "ts", 1_000_000), "orders": (t.orders, "o_orderdate", 1_000_000), "parts": (t.part, None, 5)}, NOW)
    return out.withColumn("lag_seconds", F.when(F.col("newest").isNotNull(), F.col("lag_seconds")).otherwise(F.lit(0)))


@query(
    "change_freshness_roll_up",
    "SELECT CASE WHEN greatest(0, date_sub('second', max(ts), TIMESTAMP '2024-02-01')) <= 1000000 THEN 'PARTIAL' ELSE 'STALE' END AS status FROM events",
)
def fresh_roll(t):
    return chg.freshness_roll_up(chg.freshness({"events": (t.events, "ts", 1_000_000), "parts": (t.part, None, 5)}, NOW))


def row_sql(columns):
    return " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '~')" for c in columns)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def manifest_sql(source, key, columns, buckets):
    lanes = ", ".join(f"sum(('0x' || substr(h, {1 + i * 8}, 8))::UBIGINT) AS l{i}" for i in range(4))
    return (
        f"SELECT bucket, count(*) AS n_rows, {lanes} FROM (SELECT (('0x' || substr(sha256({row_sql(key)}), 1, 8))::UBIGINT % {buckets})::INT AS bucket, "
        f"sha256({row_sql(columns)}) AS h FROM {source}) GROUP BY bucket"
    )


DIGEST = "sha256(n_rows || ':' || l0 || ':' || l1 || ':' || l2 || ':' || l3)"


@query(
    "snapshot_manifest",
    f"SELECT 'orders' AS table_name, bucket, n_rows, {DIGEST} AS digest FROM ({manifest_sql('orders', ['o_orderkey'], ORDER_COLUMNS, 30)})",
)
def manifest(t):
    return snap.manifest(t.orders.select(*ORDER_COLUMNS), "orders", ["o_orderkey"], 30)


LATER = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4001 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5003 <> 2)"


def later(t):
    status = F.when(F.col("o_orderkey") % 4001 == 1, "X").otherwise(F.col("o_orderstatus"))
    return t.orders.where("o_orderkey % 5003 <> 2").select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), "o_orderpriority")


@query(
    "snapshot_changed_buckets",
    f"WITH a AS (SELECT bucket, n_rows, {DIGEST} AS digest FROM ({manifest_sql('orders', ['o_orderkey'], ORDER_COLUMNS, 300)})), "
    f"b AS (SELECT bucket, n_rows, {DIGEST} AS digest FROM ({manifest_sql(LATER, ['o_orderkey'], ORDER_COLUMNS, 300)})) SELECT bucket, n_rows, digest FROM b WHERE digest NOT IN (SELECT digest FROM a)",
)
def changed(t):
    before = snap.manifest(t.orders.select(*ORDER_COLUMNS), "orders", ["o_orderkey"], 300)
    return snap.changed_buckets(before, snap.manifest(later(t), "orders", ["o_orderkey"], 300)).select("bucket", "n_rows", "digest")


@query(
    "snapshot_row_diff",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5003 = 2 THEN 'DELETE' ELSE 'UPDATE' END AS change, CASE WHEN o_orderkey % 5003 <> 2 THEN 'o_orderstatus' END AS columns FROM orders WHERE o_orderkey % 5003 = 2 OR o_orderkey % 4001 = 1",
)
def row_diff(t):
    return snap.row_diff(t.orders.select(*ORDER_COLUMNS), later(t), ["o_orderkey"])


@query(
    "snapshot_store_and_restore",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
)
def restored(t):
    """Two snapshots share their unchanged buckets; rewinding to the first gives the first table."""
    store = scratch_path(t.spark, "snapshots")
    snap.take(t.orders.select(*ORDER_COLUMNS), "orders", ["o_orderkey"], 64, store, "first")
    snap.take(later(t), "orders", ["o_orderkey"], 64, store, "second")
    return snap.restore(t.spark, store, "orders", "first")


@query("snapshot_retaken", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def retaken(t):
    """The second snapshot shares all buckets with the first; taking the first again, with other rows, leaves it whole."""
    store = scratch_path(t.spark, "snapshots")
    rows = t.orders.select(*ORDER_COLUMNS)
    snap.take(rows, "orders", ["o_orderkey"], 64, store, "first")
    snap.take(rows, "orders", ["o_orderkey"], 64, store, "second")
    snap.take(later(t), "orders", ["o_orderkey"], 64, store, "first")
    return snap.restore(t.spark, store, "orders", "second")


USERS = "base0 AS (SELECT DISTINCT user_id, '0.00' AS amount, '1' AS k FROM events WHERE user_id % 3 <> 0 AND user_id % 2 = 0)"


@query("snapshot_plus_replay", FEED.format(where="AND event_id <= 5000").rstrip() + ", " + BASE + APPLIED)
def advanced(t):
    store = scratch_path(t.spark, "snapshots")
    snap.take(base(t), "users", ["user_id"], 16, store, "base")
    keyed = feed(t).where(chg.has_key(F.col("pk")))
    snap.advance(t.spark, store, "users", ["user_id"], "base", "next", keyed, 5000)
    return snap.restore(t.spark, store, "users", "next")


@query(
    "snapshot_coordinated_extract",
    "SELECT 'events' AS source, count(*) AS n_rows, 'SUCCESS' AS status FROM events WHERE ts <= TIMESTAMP '2024-01-10' UNION ALL "
    "SELECT 'orders', count(*), 'SUCCESS' FROM orders WHERE o_orderdate <= TIMESTAMP '2024-01-10' UNION ALL SELECT 'future', 0, 'SUCCESS' FROM (SELECT count(*) FROM events) "
    "UNION ALL SELECT 'broken', 0, 'FAILED'",
)
def together(t):
    """An empty source is a success with no rows; one that cannot be read fails alone."""
    instant = dt.datetime(2024, 1, 10)
    later_rows = t.events.where("ts > timestamp_ntz'2024-01-10'")
    out = snap.extract_together(
        {
            "events": (t.events, "ts", ["event_id"]), "orders": (t.orders, "o_orderdate", ["o_orderkey"]),
            "future": (later_rows, "ts", ["event_id"]), "broken": (lambda: t.no_such_table, None, ["id"]),
        }, instant,
    )
    return out.select("source", "n_rows", "status")
