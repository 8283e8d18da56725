"""Content-hashed snapshots: digests per key bucket, stored once, compared, restored and advanced by a feed.

The bucket is a hash of the key, so an insert changes one bucket and leaves the rest alone. A digest is made from
sums of row-hash lanes; it does not depend on order, needs no sort, and is summed before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.keyed import hex_number
from cloakwork.session import cut
from cloakwork.streaming import changes

LANES, LANE_DIGITS = 4, 8


def cell_text(columns: Sequence[str]) -> Column:
    """Canonical text of a row: cells with their length, so that no two rows read the same."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat_ws("|", *parts)


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return (hex_number(F.substring(F.sha2(cell_text(key).cast("binary"), 256), 1, 8)) % buckets).cast("int")


def bucket_count(rows: int, per_bucket: int = 512) -> int:
    """Buckets for a table so that one holds about ``per_bucket`` rows; part of the manifest."""
    return max(1, -(-rows // per_bucket))


def manifest(df: DataFrame, table: str, key: Sequence[str], buckets: int) -> DataFrame:
    """``(table_name, bucket, n_rows, digest)`` of a table."""
    row = F.sha2(cell_text(df.columns).cast("binary"), 256)
    lanes = [hex_number(F.substring("_row", 1 + i * LANE_DIGITS, LANE_DIGITS)) for i in range(LANES)]
    hashed = df.select(bucket_of(key, buckets).alias("bucket"), row.alias("_row"))
    sums = hashed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(lane).alias(f"_l{i}") for i, lane in enumerate(lanes)]
    )
    text = F.concat_ws(":", "n_rows", *[f"_l{i}" for i in range(LANES)])
    return sums.select(F.lit(table).alias("table_name"), "bucket", "n_rows", F.sha2(text.cast("binary"), 256).alias("digest"))


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets of a newer manifest that the older one does not hold."""
    return after.join(before.select("table_name", "digest"), ["table_name", "digest"], "left_anti")


def row_diff(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that were inserted, deleted or updated, with the columns that differ."""
    b = before.select(*[F.col(k).alias(f"_b_{k}") for k in key], *[F.col(c).alias(f"_b_{c}") for c in before.columns if c not in key], F.lit(True).alias("_old"))
    a = after.withColumn("_new", F.lit(True))
    both = a.join(b, [F.col(k) == F.col(f"_b_{k}") for k in key], "full_outer")
    fields = [c for c in after.columns if c not in key and c in before.columns]
    diff = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in fields]))
    change = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").when(F.size(diff) > 0, "UPDATE")
    return both.select(
        *[F.coalesce(F.col(k), F.col(f"_b_{k}")).alias(k) for k in key], change.alias("change"),
        F.when(change == "UPDATE", F.array_join(diff, ",")).alias("columns"),
    ).where("change IS NOT NULL")


def take(df: DataFrame, table: str, key: Sequence[str], buckets: int, store: str, snapshot: str) -> DataFrame:
    """Store a snapshot and return its manifest.

    Only buckets with a digest not stored before are written, into a folder of this attempt; the manifest says for each
    bucket in which folder its rows lie. Folders are never written twice, so taking a snapshot again replaces its manifest
    and leaves alone what other manifests point to. The rows are written before the manifest that names them.
    """
    spark = df.sparkSession
    home = f"{store}/{table}"
    found = manifest(df, table, key, buckets)
    earlier = stored_manifests(spark, store, table)
    if earlier is not None:
        known = earlier.where(F.col("buckets") == buckets).groupBy("bucket", "digest").agg(F.min("stored_in").alias("_home"))
        found = found.join(known, ["bucket", "digest"], "left")
    else:
        found = found.withColumn("_home", F.lit(None).cast("string"))
    attempt = f"{snapshot}-{uuid.uuid4().hex[:12]}"
    rows = cut(
        found.select(
            "table_name", "bucket", "n_rows", "digest", F.coalesce("_home", F.lit(attempt)).alias("stored_in"), F.lit(buckets).alias("buckets")
        )
    )
    fresh = rows.where(F.col("stored_in") == attempt).select("bucket")
    data = df.withColumn("bucket", bucket_of(key, buckets)).join(fresh, "bucket", "left_semi")
    data.write.parquet(f"{home}/stored_in={attempt}")
    path = f"{store}/manifest/{table}/snapshot={snapshot}"
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored_manifests(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """Manifests of all snapshots of a table, None before the first one."""
    try:
        rows = spark.read.parquet(f"{store}/manifest/{table}")
    except AnalysisException:
        return None
    return rows.withColumn("snapshot", F.col("snapshot").cast("string"))


def restore(spark: SparkSession, store: str, table: str, snapshot: str) -> DataFrame:
    """Rows of a snapshot from the folders its manifest names; the join prunes other folders (partitions) at run time."""
    listed = spark.read.parquet(f"{store}/manifest/{table}/snapshot={snapshot}")
    data = spark.read.parquet(f"{store}/{table}").withColumn("stored_in", F.col("stored_in").cast("string"))
    return data.join(listed.select("stored_in", "bucket"), ["stored_in", "bucket"], "left_semi").drop("stored_in", "bucket")


def advance(spark: SparkSession, store: str, table: str, key: Sequence[str], base: str, name: str, feed: DataFrame, last_id=None, until=None) -> DataFrame:
    """New snapshot = stored snapshot + bounded replay. Changes without a key are refused."""
    scoped = changes.as_of(changes.in_scope(feed, [table]), last_id, until)
    if scoped.where(~F.coalesce(changes.has_key(F.col("pk")), F.lit(False))).limit(1).count():
        raise ValueError("the range holds changes without a key")
    rows = changes.apply_net(restore(spark, store, table, base), changes.net_changes(scoped), table, key)
    size = spark.read.parquet(f"{store}/manifest/{table}/snapshot={base}").agg(F.max("buckets")).first()[0]
    return take(rows, table, key, size, store, name)


def extract_together(sources: Mapping[str, tuple[DataFrame, str | None, Sequence[str]]], instant, buckets: int = 64) -> DataFrame:
    """One instant for many sources ``name -> (frame, time column, key)``: rows, digest and status per source.

    Each source is read by an action of its own. One that fails becomes a FAILED row with its error, the others go on; an
    empty source is a success with 0 rows. ``frame`` may be a function, so that opening a source may fail as well.
    """
    digest = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: b["digest"])).cast("binary"), 256)
    rows, spark = [], None
    for name, (source, column, key) in sources.items():
        try:
            df = source() if callable(source) else source
            spark = df.sparkSession
            kept = df.where(F.col(column) <= F.lit(instant)) if column else df
            found = manifest(kept, name, key, buckets)
            seen = found.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1)), digest).first()
            rows.append((name, seen[0], seen[1], "SUCCESS", seen[2], None))
        except (PySparkException, Py4JError) as error:
            rows.append((name, 0, 0, "FAILED", None, str(error).splitlines()[0][:500]))
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "source string, n_rows bigint, buckets bigint, status string, digest string, error string")


def together_status(parts: DataFrame) -> DataFrame:
    good, total = F.count_if(F.col("status") == "SUCCESS"), F.count(F.lit(1))
    return parts.agg(F.when(good == total, "SUCCESS").when(good == 0, "FAILED").otherwise("PARTIAL").alias("status"), F.sum("n_rows").alias("n_rows"))
