"""Fixed-length mainframe records: EBCDIC text, zoned, packed and binary numbers, decoded and encoded as columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.session import cut
from cloakwork.sources.versions import Versions

PAGE = "cp037"  # code page of the text fields
_DECODED = bytes(range(256)).decode(PAGE)
# Latin-1 stands for the raw byte; pairs that map to themselves are left out.
RAW = "".join(chr(i) for i in range(256) if _DECODED[i] != chr(i))
TEXT = "".join(_DECODED[i] for i in range(256) if _DECODED[i] != chr(i))


@dataclass(frozen=True)
class FieldAt:
    """Field of a record: 1-based offset, length in bytes, kind TEXT, ZONED, PACKED or BINARY, decimal places."""

    name: str
    offset: int
    length: int
    kind: str = "TEXT"
    scale: int = 0
    signed: bool = True

    @property
    def digits(self) -> int:
        return 2 * self.length - 1 if self.kind == "PACKED" else self.length


def scaled(number: Column, scale: int) -> Column:
    value = number.cast("decimal(38,0)")
    if not scale:
        return value.cast("bigint")
    return (value / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal(20,{scale})")


def decoded(record: Column, f: FieldAt) -> Column:
    """Typed value of a field."""
    raw = F.substring(record, f.offset, f.length)
    if f.kind == "TEXT":
        return F.rtrim(F.translate(F.decode(raw, "ISO-8859-1"), RAW, TEXT))
    text = F.hex(raw)
    if f.kind == "PACKED":
        digits, sign = F.substring(text, 1, 2 * f.length - 1), F.substring(text, -1, 1)
    elif f.kind == "ZONED":
        digits, sign = F.regexp_replace(text, "(.)(.)", "$2"), F.substring(text, -2, 1)
    else:
        number = F.conv(text, 16, 10).cast("decimal(20,0)")
        if f.signed:
            limit = F.lit(str(2 ** (8 * f.length - 1))).cast("decimal(20,0)")
            number = F.when(number >= limit, number - F.lit(str(2 ** (8 * f.length))).cast("decimal(20,0)")).otherwise(number)
        return scaled(number, f.scale)
    number = digits.try_cast("decimal(38,0)")
    return scaled(F.when(sign.isin("B", "D"), -number).otherwise(number), f.scale)


def encoded(value: Column, f: FieldAt) -> Column:
    """Bytes of a value; text is padded or cut to the field, numbers that do not fit stop the job."""
    if f.kind == "TEXT":
        text = F.rpad(F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, f.length), f.length, " ")
        return F.encode(F.translate(text, TEXT, RAW), "ISO-8859-1")
    units = F.coalesce(F.round(value.cast("decimal(28,8)") * 10**f.scale, 0).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    size = F.abs(units)
    if f.kind == "BINARY":
        low, high = (-(2 ** (8 * f.length - 1)), 2 ** (8 * f.length - 1) - 1) if f.signed else (0, 2 ** (8 * f.length) - 1)
        failed = F.raise_error(F.concat(F.lit(f"{f.name} does not fit: "), units.cast("string"))).cast("string")
        bits = F.lpad(F.hex(units.cast("bigint")), 16, "0")
        fits = units.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
        return F.unhex(F.substring(F.when(fits, bits).otherwise(failed), -2 * f.length, 2 * f.length))
    too_big = F.raise_error(F.concat(F.lit(f"{f.name} does not fit: "), units.cast("string"))).cast("string")
    plain = F.when(F.length(size.cast("string")) > f.digits, too_big).otherwise(F.lpad(size.cast("string"), f.digits, "0"))
    negative = units < 0
    sign = F.when(negative, "D").otherwise("C" if f.signed else "F")
    if f.kind == "PACKED":
        return F.unhex(F.concat(plain, sign))
    zones = F.regexp_replace(F.substring(plain, 1, f.length - 1), "(.)", "F$1")
    return F.unhex(F.concat(zones, sign, F.substring(plain, -1, 1)))


def read_records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """One binary column ``record`` per fixed-length record; files are split between tasks on record boundaries."""
    records = spark._jsc.binaryRecords(path, length)
    encoder = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    return DataFrame(spark._jsparkSession.createDataset(records.rdd(), encoder).toDF(), spark).toDF("record")


def decode(records: DataFrame, fields: Sequence[FieldAt]) -> DataFrame:
    return records.select(*[decoded(F.col("record"), f).alias(f.name) for f in fields])


def encode(df: DataFrame, fields: Sequence[FieldAt], length: int) -> DataFrame:
    """Rows as records; gaps between fields are EBCDIC spaces."""
    record = F.unhex(F.lit("40" * length))
    for f in fields:
        record = F.overlay(record, encoded(F.col(f.name), f), F.lit(f.offset), F.lit(f.length))
    return df.select(record.alias("record"))


def rewrite_fields(records: DataFrame, fields: Sequence[FieldAt], changed: Mapping[str, Column]) -> DataFrame:
    """Records with some fields overlaid in their original bytes; ``changed`` may use the decoded field columns."""
    known = records.select("record", *[decoded(F.col("record"), f).alias(f.name) for f in fields])
    out = F.col("record")
    for f in fields:
        if f.name in changed:
            out = F.overlay(out, encoded(changed[f.name], f), F.lit(f.offset), F.lit(f.length))
    return known.select(out.alias("record"))


def write_records(records: DataFrame, path: str) -> DataFrame:
    """Record files, one per partition, in a shared folder; returns file, records and bytes.

    A task writes under a private name and renames at the end, so a repeated task replaces its own file.
    """
    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        place, root = fs.FileSystem.from_uri(path)
        place.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{part:05d}", f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
        count = size = 0
        with place.open_output_stream(draft) as out:
            for batch in batches:
                for value in batch.column(0):
                    data = value.as_py()
                    out.write(data)
                    count, size = count + 1, size + len(data)
        if count:
            place.move(draft, name)
        else:
            place.delete_file(draft)
        yield pa.RecordBatch.from_pylist([{"file": os.path.basename(name), "records": count, "bytes": size}])

    return records.mapInArrow(write, "file string, records bigint, bytes bigint").where("records > 0")


def store_records(spark: SparkSession, records: DataFrame, root: str, keep: int = 2) -> DataFrame:
    """Record files as the next version below ``root``; returns file, records and bytes of that version.

    Each run writes a folder of its own and then points at it, so a run with fewer partitions leaves no file of an older one
    behind, and readers see the old files until the new ones are complete.
    """
    versions = Versions(spark, root)
    attempt = versions.attempt()
    written = cut(write_records(records, versions.folder(attempt)))
    versions.commit(attempt, {"records": attempt})
    versions.clean(keep)
    return written


def stored_records(spark: SparkSession, root: str, length: int) -> DataFrame:
    """Records of the newest version below ``root``."""
    return read_records(spark, Versions(spark, root).parts()["records"], length)
