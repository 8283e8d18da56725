"""Observed schema profiles and the drift between two of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.subset import Edge

PROFILE = "table_name string, column_name string, type string, nullable boolean, length bigint, scale bigint"


def observed_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Type, nulls seen, longest text and most decimal places per column, one scan per table."""
    parts = []
    for name, df in tables.items():
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).cast("string").alias("v"))
                    for f in df.schema.fields
                ]
            )
        )
        places = F.length(F.regexp_extract("p.v", r"^-?\d+\.(\d+)$", 1))
        numeric = F.col("p.type").rlike("^(decimal|double|float|tinyint|smallint|int|bigint)")
        parts.append(
            df.select(pairs.alias("p")).groupBy("p.column_name", "p.type").agg(
                (F.count_if(F.col("p.v").isNull()) > 0).alias("nullable"), F.max(F.length("p.v")).cast("bigint").alias("length"),
                F.max(F.when(numeric, places)).cast("bigint").alias("scale"),
            ).select(F.lit(name).alias("table_name"), "column_name", "type", "nullable", "length", "scale")
        )
    return reduce(DataFrame.unionByName, parts)


def key_profile(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], edges: Sequence[Edge]) -> DataFrame:
    """Repeated keys per table and orphans per foreign key."""
    parts = []
    for name, key in keys.items():
        grouped = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(grouped.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("broken")).select(
            F.lit(name).alias("table_name"), F.lit("KEY " + ",".join(key)).alias("rule"), "broken"))
    for e in edges:
        parents = tables[e.parent].select(F.col(e.parent_column).alias("_p")).distinct()
        lost = tables[e.child].where(F.col(e.child_column).isNotNull()).join(parents, F.col(e.child_column) == F.col("_p"), "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("broken")).select(
            F.lit(e.child).alias("table_name"), F.lit(f"FK {e.child_column}->{e.parent}").alias("rule"), "broken"))
    return reduce(DataFrame.unionByName, parts)


SEVERITIES = ["BLOCKER", "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
GATE = ["BLOCKER", "CRITICAL", "HIGH"]


def column_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues between two observed profiles, per table and column."""
    keys = ["table_name", "column_name"]
    b = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("type", "nullable", "length", "scale")], F.lit(True).alias("_old"))
    both = b.join(after.withColumn("_new", F.lit(True)), keys, "full_outer")
    tables_before = before.select("table_name").distinct().withColumn("_had", F.lit(True))
    tables_after = after.select("table_name").distinct().withColumn("_has", F.lit(True))
    both = both.join(F.broadcast(tables_before), "table_name", "left").join(F.broadcast(tables_after), "table_name", "left")
    have = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    same_type = F.col("old_type") == F.col("type")

    def issue(test, name: str, severity: str, old: str | None, new: str | None):
        text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
        return F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), text(old).alias("old_value"), text(new).alias("new_value")))

    shorter = F.coalesce("length", F.lit(0)) < F.coalesce("old_length", F.lit(0))
    longer = F.coalesce("length", F.lit(0)) > F.coalesce("old_length", F.lit(0))
    issues = F.array_compact(
        F.array(
            issue(F.col("_new").isNull() & F.col("_has").isNotNull(), "COLUMN_MISSING", "BLOCKER", "old_type", None),
            issue(F.col("_old").isNull() & F.col("_had").isNotNull(), "COLUMN_ADDED", "INFO", None, "type"),
            issue(have & ~same_type, "DATA_TYPE_CHANGED", "HIGH", "old_type", "type"),
            issue(have & same_type & shorter, "LENGTH_NARROWED", "HIGH", "old_length", "length"),
            issue(have & same_type & longer, "LENGTH_WIDENED", "INFO", "old_length", "length"),
            issue(have & ~F.col("old_scale").eqNullSafe(F.col("scale")), "SCALE_CHANGED", "HIGH", "old_scale", "scale"),
            issue(have & F.col("old_nullable") & ~F.col("nullable"), "NULLABILITY_TIGHTENED", "HIGH", "old_nullable", "nullable"),
            issue(have & ~F.col("old_nullable") & F.col("nullable"), "NULLABILITY_RELAXED", "MEDIUM", "old_nullable", "nullable"),
        )
    )
    return both.select(*keys, F.explode(issues).alias("i")).select(*keys, "i.*")


def table_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables that went missing or appeared."""
    b, a = before.select("table_name").distinct(), after.select("table_name").distinct()
    gone = b.join(a, "table_name", "left_anti").select("table_name", F.lit("TABLE_MISSING").alias("issue"), F.lit("BLOCKER").alias("severity"))
    new = a.join(b, "table_name", "left_anti").select("table_name", F.lit("TABLE_CREATED").alias("issue"), F.lit("INFO").alias("severity"))
    return gone.unionByName(new)


def key_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys and foreign keys that hold on one side only, or whose declaration changed."""
    b = before.select("table_name", "rule", F.col("broken").alias("old_broken"), F.lit(True).alias("_old"))
    both = b.join(after.withColumn("_new", F.lit(True)), ["table_name", "rule"], "full_outer")
    is_key = F.col("rule").startswith("KEY")
    declared = F.col("_old").isNull() | F.col("_new").isNull()
    broken = (F.coalesce("old_broken", F.lit(0)) == 0) & (F.coalesce("broken", F.lit(0)) > 0)
    name = (
        F.when(is_key & declared, "PRIMARY_KEY_CHANGED").when(is_key & broken, "UNIQUE_CONSTRAINT_CHANGED")
        .when(declared | broken, "FOREIGN_KEY_CHANGED")
    )
    severity = F.when(F.col("issue") == "PRIMARY_KEY_CHANGED", "BLOCKER").otherwise("HIGH")
    return both.withColumn("issue", name).where("issue IS NOT NULL").select("table_name", "rule", "issue", severity.alias("severity"))


def gated_load(issues: DataFrame, load: Callable[[], None]) -> None:
    """Run a load unless the drift holds a blocking issue."""
    blocking = issues.where(F.col("severity").isin(*GATE)).groupBy("table_name", "issue").agg(F.count(F.lit(1)).alias("n"))
    stop = blocking.orderBy("table_name", "issue").collect()  # one row per table and kind of issue
    if stop:
        named = ", ".join(f"{r['table_name']} {r['issue']} ({r['n']})" for r in stop)
        raise ValueError(f"schema drift stops the load: {sum(r['n'] for r in stop)} issues: {named}")
    load()
