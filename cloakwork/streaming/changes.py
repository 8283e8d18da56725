"""Change feeds: net, replay, apply, stream.

A feed row is ``(id, table_name, op, pk map, values map, captured_at)`` with op I, U or D. Netting first reduces a
feed to *cells*, one row per (table, key, column) with the newest value and its id. Cells of several batches merge
exactly, in any order of arrival, and a hot key shrinks on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("table_name", T.StringType()), T.StructField("op", T.StringType()),
        T.StructField("pk", T.MapType(T.StringType(), T.StringType())),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
        T.StructField("captured_at", T.TimestampNTZType()),
    ]
)


def feed_stream(spark: SparkSession, path: str, form: str = "json", schema: T.StructType = FEED, files: int | None = None) -> DataFrame:
    """Ordered feed as a stream over a folder; the checkpoint of the query is the confirmed position."""
    reader = spark.readStream.schema(schema).format(form)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path)


def in_scope(feed: DataFrame, tables: Sequence[str]) -> DataFrame:
    return feed.where(F.lower("table_name").isin(*[t.lower() for t in tables]))


def as_of(feed: DataFrame, last_id: int | None = None, until=None) -> DataFrame:
    """Bounded replay: up to an id and/or a capture time."""
    if last_id is not None:
        feed = feed.where(F.col("id") <= last_id)
    if until is not None:
        feed = feed.where(F.col("captured_at") <= F.lit(until))
    return feed


def has_key(pk: Column) -> Column:
    return pk.isNotNull() & (F.size(pk) > 0)


def without_key(feed: DataFrame) -> DataFrame:
    """Changes that cannot be netted, counted per table."""
    return feed.where(~F.coalesce(has_key(F.col("pk")), F.lit(False))).groupBy("table_name").agg(F.count(F.lit(1)).alias("skipped"))


def key_text(pk: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pk))))


def _reduced(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_name", "key", "column_name").agg(
        F.max_by("value", "id").alias("value"), F.max_by("op", "id").alias("op"), F.max("deleted_at").alias("deleted_at"),
        F.max("inserted_at").alias("inserted_at"), F.max("id").alias("id"),
    )


def cells(feed: DataFrame) -> DataFrame:
    """Newest value per (table, key, column) plus one cell per key (no column) for its operations."""
    changed = F.map_entries(F.when((F.col("op") != "D") & F.col("values").isNotNull(), F.col("values")).otherwise(F.create_map().cast("map<string,string>")))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = feed.where(has_key(F.col("pk"))).select(
        "table_name", key_text(F.col("pk")).alias("key"), F.explode(F.concat(marker, changed)).alias("cell"), "op",
        F.when(F.col("op") == "D", F.col("id")).alias("deleted_at"), F.when(F.col("op") == "I", F.col("id")).alias("inserted_at"), "id",
    )
    return _reduced(
        rows.select(
            "table_name", "key", F.col("cell.key").alias("column_name"), F.col("cell.value").alias("value"), "op", "deleted_at",
            "inserted_at", "id",
        )
    )


def merge_cells(stored: DataFrame) -> DataFrame:
    """Cells of several batches reduced to one set."""
    return _reduced(stored)


def net(reduced: DataFrame) -> DataFrame:
    """One row per (table, key): D, or I/U with all values since the last delete; key columns are filled in."""
    cell = F.struct("column_name", "id", "value")
    keyed = reduced.groupBy("table_name", "key").agg(
        F.max_by("op", "id").alias("last_op"), F.max("deleted_at").alias("deleted_at"), F.max("inserted_at").alias("inserted_at"),
        F.max("id").alias("last_id"), F.collect_list(F.when(F.col("column_name").isNotNull(), cell)).alias("cells"),
    )
    start = F.coalesce(F.col("deleted_at"), F.lit(-1))
    fresh = F.filter("cells", lambda c: c["id"] > F.coalesce(F.col("deleted_at"), F.lit(-1)))
    changed = F.map_from_entries(F.transform(fresh, lambda c: F.struct(c["column_name"].alias("key"), c["value"].alias("value"))))
    pk = F.from_json("key", "map<string,string>")
    op = F.when(F.col("last_op") == "D", "D").when(F.col("inserted_at") > start, "I").otherwise("U")
    out = keyed.withColumn("pk", pk).withColumn("changed", changed).withColumn("op", op)
    missing = F.map_filter("pk", lambda k, v: ~F.map_contains_key("changed", k))
    full = F.when(F.col("op") == "D", F.create_map().cast("map<string,string>")).otherwise(F.map_concat("changed", missing))
    return out.select("table_name", "pk", "op", full.alias("values"), "last_id", "deleted_at")


def net_changes(feed: DataFrame) -> DataFrame:
    return net(cells(feed))


def apply_net(target: DataFrame, netted: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Target after the netted changes; absent columns keep their value, null ones become null.

    The target is joined to the changes from its own side, and changes of keys it does not hold are added, so a small feed
    is broadcast and a large target is neither shuffled nor sorted.
    """
    kinds = {f.name: f.dataType for f in target.schema.fields}
    mine = netted.where(F.lower("table_name") == table.lower()).select(
        *[F.col("pk")[k].try_cast(kinds[k]).alias(f"_k_{k}") for k in key], "op", "values", "deleted_at"
    )
    same = [F.col(k) == F.col(f"_k_{k}") for k in key]
    there = target.select(*key).join(mine.select(*[f"_k_{k}" for k in key]), same, "left_semi").select(*[F.col(k).alias(f"_k_{k}") for k in key])
    new = mine.join(there, [f"_k_{k}" for k in key], "left_anti").where("op <> 'D'")
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    joined = target.join(mine, same, "left").unionByName(new.select(*blank, *[f"_k_{k}" for k in key], "op", "values", "deleted_at"))
    kept = joined.where(F.col("op").isNull() | (F.col("op") != "D"))
    out = []
    for name, kind in kinds.items():
        if name in key:
            out.append(F.coalesce(F.col(name), F.col(f"_k_{name}")).alias(name))
            continue
        given = F.map_contains_key("values", F.lit(name))
        old = F.when(F.col("deleted_at").isNull(), F.col(name))
        out.append(
            F.when(F.col("op").isNull(), F.col(name)).when(given, F.try_element_at("values", F.lit(name)).try_cast(kind)).otherwise(old).alias(name)
        )
    return kept.select(*out)


def replay(target: DataFrame, feed: DataFrame, table: str, key: Sequence[str], last_id: int | None = None, until=None) -> DataFrame:
    """Target as it was after a prefix of the feed; its name may be written in any case."""
    mine = in_scope(feed, [table]).withColumn("table_name", F.lit(table))
    return apply_net(target, net_changes(as_of(mine, last_id, until)), table, key)


# ---------------------------------------------------------------- streams

def store_cells(path: str):
    """Sink for ``foreachBatch``: each micro-batch leaves its cells in its own folder, so a repeated batch only
    overwrites itself. State is the stored cells, not executor memory, and work grows with the changes alone."""

    def write(batch: DataFrame, number: int) -> None:
        cells(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Stored batches merged into one new store; the old one can go once readers have moved on."""
    merge_cells(spark.read.parquet(path).drop("batch")).write.mode("overwrite").parquet(f"{into}/batch=0")


def run_available(stream: DataFrame, write, checkpoint: str) -> None:
    """Process what has arrived and stop; the same query with another trigger runs continuously."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(target: DataFrame, path: str, table: str, key: Sequence[str]) -> DataFrame:
    """Target with all stored batches applied."""
    stored = target.sparkSession.read.parquet(path).drop("batch")
    return apply_net(target, net(merge_cells(stored.where(F.lower("table_name") == table.lower()))), table, key)


def freshness(members: Mapping[str, tuple[DataFrame, str | None, int]], now) -> DataFrame:
    """Lag per member ``name -> (frame, timestamp column, allowed seconds)`` with FRESH, STALE or UNKNOWN."""
    parts = None
    for name, (df, column, allowed) in members.items():
        if column is None:
            row = df.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("newest"))
        else:
            row = df.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("newest"))
        lag = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("newest"), F.lit(now).cast("timestamp_ntz")))
        row = row.select(
            F.lit(name).alias("member"), "newest", lag.alias("lag_seconds"),
            F.when(F.col("newest").isNull(), "UNKNOWN").when(lag <= allowed, "FRESH").otherwise("STALE").alias("status"),
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def freshness_roll_up(status: DataFrame) -> DataFrame:
    has = lambda s: F.count_if(F.col("status") == s) > 0
    return status.agg(
        F.when(has("FAILED"), "FAILED").when(has("STALE"), "STALE").when(has("UNKNOWN") & has("FRESH"), "PARTIAL")
        .when(has("FRESH"), "FRESH").otherwise("UNKNOWN").alias("status")
    )
