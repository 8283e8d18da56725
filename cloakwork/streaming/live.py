"""Continuous apply: a bucketed target that takes a change feed batch by batch, repeated or out of order, and stays exact."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.sources.versions import Versions
from cloakwork.streaming import changes

CELLS = "key string, column_name string, value string, op string, deleted_at long, inserted_at long, id long"


class LiveTable:
    """A table kept up to date by a feed.

    Rows lie in ``buckets`` by the hash of their key. A row knows the id of the newest change of each column, of its last
    operation and of its last delete, and deleted rows stay as marks, so changes may arrive in any order and any number of times:
    the newest id of each column wins, and nothing from before a delete comes back. A batch only writes its own cells, as a delta
    of each bucket it touches; a bucket with ``deltas`` of them is compacted, and no other bucket is rewritten. Work per batch
    grows with the batch, the part of compaction with the buckets that changed. Every step is one commit (``Versions``): readers
    see the table before or after it.

    Changes of other tables are ignored. Changes without a key, or with key values that are no values of the key columns' types,
    are skipped and counted in the commit's note. Values that don't fit their column become null, as in a batch apply. One
    stream at a time writes.
    """

    def __init__(self, spark: SparkSession, root: str, table: str, key: Sequence[str], buckets: int = 64, deltas: int = 8, keep: int = 2):
        self.spark, self.table, self.key, self.buckets, self.deltas, self.keep = spark, table, sorted(key), buckets, deltas, keep
        self.versions = Versions(spark, root)

    # ------------------------------------------------------------ state

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _state(self, row: T.StructType) -> T.StructType:
        marks = "ids map<string,long>, last_id long, last_op string, deleted_at long, inserted_at long"
        return T.StructType([T.StructField("key", T.StringType()), T.StructField("row", row), *T._parse_datatype_string(marks).fields])

    def _newest(self) -> tuple:
        """(newest entry, type of a row)."""
        entry = self.versions.latest()
        if entry is None:
            raise FileNotFoundError(f"create the table below {self.versions.root} first")
        return entry, T.StructType.fromJson(json.loads(entry["note"]["row"]))

    def _write(self, state: DataFrame, attempt: str, fields: Sequence[str]) -> list[int]:
        """Rows into a folder per bucket; numbers of the buckets, of which there are ``buckets`` at most."""
        path = self.versions.folder(attempt)
        rows = state.withColumn("bucket", self._bucket()).select(*fields, "bucket")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return [r["bucket"] for r in self.spark.read.schema(rows.schema).parquet(path).select("bucket").distinct().collect()]

    def _base(self, parts: Iterable[str], row: T.StructType) -> DataFrame:
        paths = list(parts)
        schema = self._state(row)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _incoming(self, parts: Iterable[str]) -> DataFrame:
        """One row per key of the given deltas: its newest cell of each column, last operation and last delete."""
        paths = list(parts)
        stored = self.spark.read.schema(CELLS).parquet(*paths) if paths else self.spark.createDataFrame([], CELLS)
        merged = changes.merge_cells(stored.withColumn("table_name", F.lit(self.table)))
        cell = F.struct(F.col("column_name").alias("key"), F.struct("id", "value").alias("value"))
        return merged.groupBy("key").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("column_name").isNotNull(), cell))).alias("new"), F.max("id").alias("new_id"),
            F.max_by("op", "id").alias("new_op"), F.max("deleted_at").alias("new_deleted"), F.max("inserted_at").alias("new_inserted"),
        )

    def _merged(self, base: DataFrame, incoming: DataFrame, row: T.StructType) -> DataFrame:
        """State after the changes. Joined from the side of the base, so that few changes are broadcast and it isn't shuffled."""
        there = base.select("key").join(incoming.select("key"), "key", "left_semi")
        added = incoming.join(there, "key", "left_anti")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields if f.name != "key"]
        both = base.join(incoming, "key", "left").unionByName(added.select("key", *blank, *[c for c in incoming.columns if c != "key"]))
        gone = F.greatest("deleted_at", "new_deleted")
        pk = F.from_json("key", "map<string,string>")
        values, ids = [], []
        for f in row.fields:
            if f.name in self.key:
                values.append(F.coalesce(F.col("row")[f.name], F.try_element_at(pk, F.lit(f.name)).try_cast(f.dataType)).alias(f.name))
                continue
            cell, own = F.try_element_at("new", F.lit(f.name)), F.try_element_at("ids", F.lit(f.name))
            newer = F.coalesce(cell["id"] >= F.coalesce(own, F.lit(-1)), F.lit(False))
            id_ = F.when(newer, cell["id"]).otherwise(own)
            alive = gone.isNull() | F.coalesce(id_ > gone, F.lit(False))
            values.append(F.when(alive, F.when(newer, cell["value"].try_cast(f.dataType)).otherwise(F.col("row")[f.name])).alias(f.name))
            ids.append(F.struct(F.lit(f.name).alias("key"), F.when(alive, id_).alias("value")))
        known = F.filter(F.array(*ids), lambda e: e["value"].isNotNull()) if ids else F.array().cast("array<struct<key:string,value:bigint>>")
        later = F.coalesce(F.col("new_id") >= F.coalesce("last_id", F.lit(-1)), F.lit(False))
        return both.select(
            "key", F.struct(*values).alias("row"), F.map_from_entries(known).alias("ids"), F.greatest("last_id", "new_id").alias("last_id"),
            F.when(later, F.col("new_op")).otherwise(F.col("last_op")).alias("last_op"), gone.alias("deleted_at"),
            F.greatest("inserted_at", "new_inserted").alias("inserted_at"),
        )

    def _key_text(self, row: T.StructType, value: Callable[[str], object]):
        return changes.key_text(F.create_map(*[x for k in self.key for x in (F.lit(k), value(k).try_cast(row[k].dataType).cast("string"))]))

    # ------------------------------------------------------------ use

    def create(self, target: DataFrame) -> int:
        """Start from the rows of ``target``, older than any change; they need a key without nulls, once per row."""
        key = self._key_text(target.schema, lambda k: F.col(k))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._state(target.schema).fields[2:]]
        state = target.select(key.alias("key"), F.struct(*target.columns).alias("row"), *blank).withColumn("ids", F.create_map().cast("map<string,bigint>"))
        attempt = self.versions.attempt()
        found = self._write(state, attempt, [f.name for f in self._state(target.schema).fields])
        return self.versions.commit(attempt, {f"base/{b}": f"{attempt}/bucket={b}" for b in found}, {"row": target.schema.json()})

    def apply(self, batch: DataFrame, number: int | None = None) -> int | None:
        """Take in a batch of the feed; version of the table, or None if nothing in it concerns the table."""
        entry, row = self._newest()
        attempt, seen = self.versions.attempt(entry), Observation()
        mine = changes.in_scope(batch, [self.table]).withColumn("pk", F.create_map(
            *[x for k in self.key for x in (F.lit(k), F.try_element_at("pk", F.lit(k)).try_cast(row[k].dataType).cast("string"))]))
        whole = F.forall(F.map_values("pk"), lambda v: v.isNotNull())
        counted = mine.observe(seen, F.count_if(~whole).alias("skipped"))
        found = self._write(changes.cells(counted.where(whole)), attempt, T._parse_datatype_string(CELLS).names)
        if not found:
            return None
        parts = dict(entry["parts"]) | {f"delta/{b}/{attempt}": f"{attempt}/bucket={b}" for b in found}
        version = self.versions.commit(attempt, parts, {"row": row.json(), "batch": str(number), "skipped": str(seen.get["skipped"])})
        count: dict[str, int] = {}
        for name in parts:
            if name.startswith("delta/"):
                count[name.split("/")[1]] = count.get(name.split("/")[1], 0) + 1
        full = sorted(int(b) for b, n in count.items() if n >= self.deltas)
        return self.compact(full) if full else version

    def compact(self, buckets: Sequence[int] | None = None) -> int:
        """Rewrite the given buckets (all that have deltas) as one base each; the parts of other buckets stay as they are."""
        entry, row = self._newest()
        parts, folders, attempt = dict(entry["parts"]), self.versions.parts(entry), self.versions.attempt(entry)
        chosen = {str(b) for b in buckets} if buckets is not None else {n.split("/")[1] for n in parts if n.startswith("delta/")}
        old = {name for name in parts if name.split("/")[1] in chosen}
        state = self._merged(
            self._base([folders[n] for n in old if n.startswith("base/")], row), self._incoming(folders[n] for n in old if n.startswith("delta/")), row
        )
        found = self._write(state, attempt, [f.name for f in self._state(row).fields])
        parts = {n: p for n, p in parts.items() if n not in old} | {f"base/{b}": f"{attempt}/bucket={b}" for b in found}
        version = self.versions.commit(attempt, parts, {"row": row.json(), "compacted": str(len(chosen))})
        self.versions.clean(self.keep)
        return version

    def read(self) -> DataFrame:
        """The table as of the newest commit."""
        entry, row = self._newest()
        folders = self.versions.parts(entry)
        deltas = [p for n, p in folders.items() if n.startswith("delta/")]
        state = self._base([p for n, p in folders.items() if n.startswith("base/")], row)
        if deltas:
            state = self._merged(state, self._incoming(deltas), row)
        return state.where("last_op IS NULL OR last_op <> 'D'").select("row.*")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, number: self.apply(batch, number) and None
