"""Session settings and the few places where a job needs shared storage or a size check."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  # above this a side is never hinted as broadcast


def get_spark(app: str = "cloakwork", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame once to reliable storage and go on from the copy; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a frame whose row count was checked; larger frames stay with AQE's choice."""
    seen = df.limit(rows + 1).count()
    return F.broadcast(df) if seen <= rows else df


TASK_ROWS = 50_000  # rows that one task of costly expressions gets


def task_count(df: DataFrame) -> int:
    """Tasks for the rows of a table scan: as many as the cluster has cores, and none beyond TASK_ROWS rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """More tasks for costly expressions on a table scan: as many as the cluster has cores, and no task beyond TASK_ROWS rows.

    A file is read by few tasks, whatever its rows cost later, so the number of tasks follows the rows: the longest task stays as
    long as it is when the table grows. A scan with enough splits passes through unchanged. For scans only: asking a plan with
    joins for its partitions would run its shuffles.
    """
    wanted = task_count(df)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
