"""Loading results: replace, append, update, upsert, in place, by partition, routed, with rejects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.operators.mapping import route


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("append").format(form).save(path)


def empty_target(spark: SparkSession, path: str, form: str = "parquet") -> None:
    """TRUNCATE_ONLY: same columns, no rows."""
    schema = spark.read.format(form).load(path).schema
    replace(spark.createDataFrame([], schema), path, form)


def create_like(spark: SparkSession, source: DataFrame, path: str, form: str = "parquet") -> None:
    """Target with the columns, types and nullability of a source and no rows."""
    replace(spark.createDataFrame([], source.schema), path, form)


def prepare(spark: SparkSession, path: str, how: str, where: str | None = None) -> None:
    """Target preparation before a load: NONE, TRUNCATE, or DELETE of the rows under a condition."""
    how = how.upper()
    if how == "TRUNCATE" or (how == "DELETE" and not where):
        empty_target(spark, path)
    elif how == "DELETE":
        rewrite_in_place(spark, path, lambda rows: rows.where(~F.coalesce(F.expr(where), F.lit(False))))


def _present(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys],
        F.lit(True).alias("_hit"),
    )


def updated(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target with the values of the matching source rows; nothing is added."""
    joined = target.join(_present(source, keys), [F.col(k) == F.col(f"_s_{k}") for k in keys], "left")
    return _merged(joined, target.columns, source.columns, keys, F.col("_hit"))


def upserted(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matching rows updated, the rest of the source inserted.

    A left join and a union: when the source is small it is broadcast, and the target is neither shuffled nor sorted.
    """
    own = target.select(*keys).join(source.select(*keys), list(keys), "left_semi")
    new = source.join(own, list(keys), "left_anti")
    absent = [F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns if c not in source.columns]
    return updated(target, source, keys).unionByName(
        new.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in source.columns if c in target.columns], *absent)
    )


def _merged(joined: DataFrame, columns: Sequence[str], given: Sequence[str], keys: Sequence[str], hit: Column) -> DataFrame:
    out = []
    for c in columns:
        if c in keys:
            out.append(F.coalesce(F.col(c), F.col(f"_s_{c}")).alias(c))
        elif c in given:
            out.append(F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def rewrite_in_place(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], form: str = "parquet") -> None:
    """Read, change, write beside the target, then swap the folders, so a lost job never leaves half a table."""
    rows = spark.read.format(form).load(path)
    replace(change(rows), f"{path}.next", form)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new, final = (hadoop.Path(p) for p in (f"{path}.old", f"{path}.next", path))
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(final, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(new, final):
        if not files.rename(old, final):
            raise OSError(f"the new table is in {path}.next, the old one in {path}.old")
        raise OSError(f"cannot put {path}.next in place; the old table stays")
    files.delete(old, True)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str], form: str = "parquet") -> None:
    """Only the partitions that occur in the frame are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def load_routes(df: DataFrame, conditions: Mapping[str, str | None], path: str) -> None:
    """Router load: one pass over the input, one folder per route."""
    route(df, conditions).write.mode("overwrite").partitionBy("route").parquet(path)


@dataclass(frozen=True)
class Fitted:
    good: DataFrame
    rejected: DataFrame


def split_rejects(df: DataFrame, kinds: Mapping[str, str], required: Sequence[str] = ()) -> Fitted:
    """Rows whose values can be cast, and rows that cannot with the columns at fault."""
    bad = []
    for name, kind in kinds.items():
        failed = F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()
        bad.append(F.when(failed | (F.col(name).isNull() & F.lit(name in required)), F.lit(name)))
    marked = df.withColumn("rejected_for", F.array_compact(F.array(*bad)))
    casts = [F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns]
    return Fitted(
        marked.where(F.size("rejected_for") == 0).select(*casts), marked.where(F.size("rejected_for") > 0)
    )


def check_rejects(fitted: Fitted, most: int) -> int:
    """Number of rejects; more than ``most`` stops the load."""
    count = fitted.rejected.count()
    if count > most:
        raise ValueError(f"{count} rejected rows, at most {most} allowed")
    return count


def project_targets(df: DataFrame, targets: Mapping[str, Mapping[str, str]]) -> dict[str, DataFrame]:
    """One logical dataset under several physical names and column lists (``target column -> source column``)."""
    return {name: df.select(*[F.col(s).alias(c) for c, s in columns.items()]) for name, columns in targets.items()}


def fit(value: Column, kind: T.DataType, length: int | None = None, name: str = "value") -> Column:
    """Value in the form of its target: text cut by code point, decimals exact or the job fails, strict booleans."""
    text = value.cast("string")
    if isinstance(kind, T.StringType):
        return F.substring(text, 1, length) if length else text
    if isinstance(kind, T.DecimalType):
        exact = text.try_cast(kind)
        lost = text.isNotNull() & (exact.isNull() | (exact != text.try_cast("decimal(38,18)")))
        return F.when(lost, F.raise_error(F.concat(F.lit(f"{name} does not fit: "), text)).cast(kind)).otherwise(exact)
    if isinstance(kind, T.BooleanType):
        word = F.lower(F.trim(text))
        known = F.when(word.isin("true", "t", "1", "y", "yes"), True).when(word.isin("false", "f", "0", "n", "no"), False)
        failed = F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), text)).cast("boolean")
        return F.when(text.isNotNull() & known.isNull(), failed).otherwise(known)
    return text.cast(kind)


def row_digest(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def write_with_digest(df: DataFrame, path: str, form: str, **options) -> dict[str, object]:
    """Write once; row count and an order-free digest are observed in the same pass."""
    seen = Observation()
    df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(row_digest(df.columns).cast("decimal(38,0)")).alias("digest")
    ).write.mode("overwrite").format(form).options(**options).save(path)
    return seen.get


def write_csv(df: DataFrame, path: str, sep: str = ",") -> dict[str, object]:
    """Values keep white space at their ends, which Spark's writer drops by default."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return write_with_digest(df, path, "csv", header=True, sep=sep, quote='"', escape='"', **kept)


def write_json(df: DataFrame, path: str) -> dict[str, object]:
    return write_with_digest(df, path, "json")
