"""File and table sources: delimited, JSON lines, JSON documents, XML, JDBC; type inference in one pass."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, multi_line: bool = False) -> DataFrame:
    """Text columns of a CSV or TSV file; values are not trimmed, blank lines are skipped; nothing is null, two quotes are empty text."""
    empty = uuid.uuid4().hex  # Spark reads two quotes as null too, unless they stand for a text of their own; no file can hold this one
    read = spark.read.options(
        sep=sep, header=header, quote='"', escape='"', multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        emptyValue=empty,
    ).csv(path)
    named = read.toDF(*[f"_c{i}" if c.startswith(empty) else c for i, c in enumerate(read.columns)])
    cells = {n: F.col("`" + n.replace("`", "``") + "`") for n in named.columns}
    return named.select(*[F.when(c == empty, "").otherwise(c).alias(n) for n, c in cells.items()])


def nested_as_text(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; nested values stay as JSON text. Give a schema for large files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nested_as_text(reader.json(path))


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file with an array (rows) or one object (a row)."""
    reader = spark.read.option("multiLine", True)
    return nested_as_text((reader.schema(schema) if schema is not None else reader).json(path))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Repeated child elements as rows."""
    reader = spark.read.option("rowTag", row_tag)
    return nested_as_text((reader.schema(schema) if schema is not None else reader).xml(path))


def flatten_json(df: DataFrame, column: str, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Top-level keys of a JSON text column as text columns; nested values stay text, a bare scalar becomes ``value``."""
    picked = [F.get_json_object(F.col(column), f"$.{k}").alias(k) for k in keys]
    scalar = F.when(~F.trim(F.col(column)).rlike(r"^[{\[]"), F.col(column)).alias("value")
    return df.select(*keep, *picked, scalar)


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct top-level keys of a JSON text column."""
    return df.select(F.explode(F.json_object_keys(F.col(column))).alias("name")).distinct()


def kind_tests(value: Column) -> dict[str, Column]:
    return {
        "NUMBER": value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"),
        "BOOLEAN": F.lower(value).isin("true", "false"),
        "TIMESTAMP": value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$") & F.substring(value, 1, 10).try_cast("date").isNotNull(),
        "DATE": value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull(),
    }


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NUMBER, BOOLEAN, TIMESTAMP, DATE, STRING or UNKNOWN per column: a type holds when every non-null value has it."""
    names = list(columns or df.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names]))
    tests = kind_tests(F.col("p.v"))
    counted = df.select(pairs.alias("p")).groupBy("p.column_name").agg(
        F.count("p.v").alias("n"), *[F.count_if(test).alias(kind) for kind, test in tests.items()]
    )
    out = F.when(F.col("n") == 0, "UNKNOWN")
    for kind in tests:
        out = out.when(F.col(kind) == F.col("n"), kind)
    return counted.select("column_name", out.otherwise("STRING").alias("inferred"), F.col("n").alias("non_null"))


SPARK_TYPES = {"NUMBER": "decimal(38,10)", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date"}


def typed(df: DataFrame, inferred: DataFrame) -> DataFrame:
    """Columns cast to their inferred types (one small row per column is read)."""
    kinds = {r["column_name"]: r["inferred"] for r in inferred.collect()}
    return df.select(*[F.col(c).cast(SPARK_TYPES[kinds[c]]).alias(c) if kinds.get(c) in SPARK_TYPES else F.col(c) for c in df.columns])


def read_jdbc(
    spark: SparkSession, url: str, table: str, split: str | None = None, low: int | None = None, high: int | None = None,
    parts: int = 64, fetch: int = 10_000, **options: str,
) -> DataFrame:
    """Database table; with a numeric split column the ranges are read by separate tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if split is not None:
        reader = reader.options(partitionColumn=split, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).save()
