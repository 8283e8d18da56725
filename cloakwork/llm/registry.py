"""Queries of this subpackage and the SQL that gives the same rows, where SQL can say it."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOT = Path(__file__).resolve().parents[2]


@functools.lru_cache(maxsize=8)
def _sent(application: str) -> str:
    """Archive of the package, made once per application on the driver; Spark's file server hands it to the executors."""
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "cloakwork"), "zip", ROOT, "cloakwork")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path doesn't hold it yet."""
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.addPyFile(_sent(spark.sparkContext.applicationId))


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(spark, folder.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
