"""Business entities: all members of each root key together, with versions, identity links and reservations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.keyed import hex_number
from cloakwork.operators.positions import group_positions
from cloakwork.session import cut, small_side
from cloakwork.streaming.snapshots import LANES, cell_text

FRAGMENT_ROWS = 1_000


@dataclass(frozen=True)
class Member:
    """Table of an entity: the column with the root key, or a hop ``(own column, via frame, via key, root column)``."""

    name: str
    frame: DataFrame
    root_column: str | None = None
    hop: tuple[str, DataFrame, str, str] | None = None


def with_root(member: Member) -> DataFrame:
    """Member rows with their root key as ``entity``."""
    if member.hop is None:
        return member.frame.withColumn("entity", F.col(member.root_column))
    own, via, via_key, root = member.hop
    path = via.select(F.col(via_key).alias("_via"), F.col(root).alias("entity"))
    return member.frame.join(path, F.col(own) == F.col("_via")).drop("_via")


def fragments(members: Sequence[Member], per_fragment: int = FRAGMENT_ROWS) -> DataFrame:
    """``(entity, member, part, rows, n_rows, lane_0 .. lane_3)`` for every key at once.

    A member with many rows for one key is cut by row hash, without a sort, into parts of a quarter of ``per_fragment``, so that
    hardly any exceeds it by chance; one that does, as with many equal rows, is cut by position. So no part holds more than
    ``per_fragment`` rows and no row is left out.
    Rows are kept as JSON text. The lanes are sums of row-hash slices: they do not depend on the order of rows, and together make
    the digest of a capsule. A member's rows are read once for the sizes, once for the parts and once for the fragments; rows of
    parts that are too large, wherever there are any, are read for these alone.
    """
    out = []
    for m in members:
        columns = m.frame.columns
        rows = with_root(m)
        count = F.count(F.lit(1))
        sizes = cut(rows.groupBy(F.col("entity").alias("_e")).agg(F.ceil(4 * count / per_fragment).alias("_parts")).where("_parts > 4"))
        dealt = F.pmod(F.xxhash64(cell_text(columns)), "_parts")  # equal rows share a part; no digest is needed to deal them
        counted = rows.join(sizes, F.col("entity") == F.col("_e")).groupBy("_e", dealt.alias("_p")).agg(count.alias("_n"))
        over = cut(counted.where(F.col("_n") > per_fragment).select("_e", "_p"))
        row_hash = F.sha2(cell_text(columns).cast("binary"), 256)
        held = ["entity", F.to_json(F.struct(*columns)).alias("row"), row_hash.alias("hash"), F.coalesce(dealt, F.lit(0)).alias("part"), "_parts"]
        parts = rows.join(sizes, F.col("entity") == F.col("_e"), "left").select(*held)
        if not over.isEmpty():
            few = small_side(over)
            same = (F.col("entity") == F.col("_e")) & (F.col("part") == F.col("_p"))
            of_these = rows.join(few.select(F.col("_e").alias("_x")), F.col("entity") == F.col("_x"), "left_semi")
            crowded = cut(of_these.join(sizes, F.col("entity") == F.col("_e")).select(*held).join(few, same, "left_semi"))
            placed = group_positions(crowded, ["entity", "part"], ["hash"], "_place").drop("group_rows")
            split = placed.withColumn("part", F.col("part") + F.col("_parts") * F.floor((F.col("_place") - 1) / per_fragment)).drop("_place")
            parts = parts.join(few, same, "left_anti").unionByName(split)
        parts = parts.select("entity", "row", "hash", F.col("part").cast("int").alias("part"))
        lanes = [F.sum(hex_number(F.substring("hash", 1 + 8 * i, 8))).alias(f"lane_{i}") for i in range(LANES)]
        out.append(
            parts.groupBy("entity", "part").agg(F.collect_list("row").alias("rows"), F.count(F.lit(1)).alias("n_rows"), *lanes)
            .withColumn("member", F.lit(m.name))
        )
    return reduce(DataFrame.unionByName, out)


def capsule(parts: DataFrame) -> DataFrame:
    """One row per entity and member: rows, parts and a digest over the parts."""
    summed = parts.groupBy("entity", "member").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("parts"), *[F.sum(f"lane_{i}").alias(f"lane_{i}") for i in range(LANES)]
    )
    text = F.concat_ws(":", "n_rows", *[f"lane_{i}" for i in range(LANES)])
    return summed.select("entity", "member", "n_rows", "parts", F.sha2(text.cast("binary"), 256).alias("digest"))


def add_version(history: DataFrame, current: DataFrame, key: str, label: str) -> DataFrame:
    """Current content appended as the next version of each key (``version`` starts at 1)."""
    last = history.groupBy(key).agg(F.max("version").alias("_last"))
    new = current.join(last, key, "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).withColumn("label", F.lit(label)).drop("_last")
    return history.unionByName(new.select(*history.columns))


def restore_version(history: DataFrame, key: str, version: int, label: str = "RESTORED") -> DataFrame:
    """An older version again, as a new version of every key that has it."""
    old = history.where(F.col("version") == version).drop("version", "label")
    return add_version(history, old, key, label)


def newest(history: DataFrame, key: str) -> DataFrame:
    """Latest version per key; reduced before the shuffle."""
    rest = [c for c in history.columns if c not in (key, "version")]
    return history.groupBy(key).agg(F.max("version").alias("version"), F.max_by(F.struct(*rest), "version").alias("_v")).select(key, "version", "_v.*")


def provision(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target with the rows of the provisioned keys replaced: delete by key tuple, then insert."""
    return target.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows.select(*target.columns))


def member_counts(members: Sequence[Member], criteria: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per member under its own criteria."""
    parts = []
    for m in members:
        rows = m.frame.where(criteria[m.name]) if criteria and m.name in criteria else m.frame
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(m.name).alias("member"), "n_rows"))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- identity

def link_hash(system: Column | str, keys: Sequence[Column]) -> Column:
    """Hash of a system name and its key values; values are trimmed and lower case."""
    name = F.lit(system) if isinstance(system, str) else system
    cells = [F.coalesce(F.lower(F.trim(k.cast("string"))), F.lit("")) for k in keys]
    return F.sha2(F.concat_ws("\x1f", F.lower(name), *cells).cast("binary"), 256)


def links(df: DataFrame, system: str, keys: Sequence[str], subject: Column, updated: Column) -> DataFrame:
    return df.select(
        link_hash(system, [F.col(k) for k in keys]).alias("link"), F.lit(system).alias("system"), subject.alias("subject"), updated.alias("updated_at")
    )


def link_conflicts(crosswalk: DataFrame) -> DataFrame:
    """Links that lead to more than one subject."""
    pairs = crosswalk.select("link", "subject").distinct()
    return pairs.groupBy("link").agg(F.count(F.lit(1)).alias("subjects"), F.min("subject").alias("one"), F.max("subject").alias("other")).where("subjects > 1")


def resolve(requests: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Subject of each requested link: the latest active one."""
    latest = crosswalk.where("active").groupBy("link").agg(F.max_by("subject", F.struct("updated_at", "subject")).alias("subject"))
    return requests.join(latest, "link", "left")


# ---------------------------------------------------------------- reservations

def active(reservations: DataFrame, now) -> DataFrame:
    return reservations.where((F.col("status") == "ACTIVE") & (F.col("expires_at") > F.lit(now)))


def expire(reservations: DataFrame, now, release: Sequence[str] = ()) -> DataFrame:
    """ACTIVE and past becomes EXPIRED; named holders are released."""
    held = F.col("status") == "ACTIVE"
    status = (
        F.when(held & F.col("holder").isin(*release) if release else F.lit(False), "RELEASED")
        .when(held & (F.col("expires_at") <= F.lit(now)), "EXPIRED").otherwise(F.col("status"))
    )
    return reservations.withColumn("status", status)


def reserve(df: DataFrame, key: str, where: str, count: int, reservations: DataFrame, now, holder: str, until) -> DataFrame:
    """First free keys that match; too few stop the request."""
    taken = active(reservations, now).select(F.col("entity").alias("_taken"))
    free = df.where(where).join(taken, F.col(key) == F.col("_taken"), "left_anti")
    chosen = free.select(F.col(key).alias("entity")).orderBy("entity").limit(count)
    found = chosen.count()
    if found < count:
        raise ValueError(f"{found} of {count} requested keys are free")
    return chosen.select("entity", F.lit(holder).alias("holder"), F.lit("ACTIVE").alias("status"), F.lit(until).cast("timestamp_ntz").alias("expires_at"))


def conflicts(requested: DataFrame, reservations: DataFrame, now) -> DataFrame:
    """Requested keys that are actively reserved."""
    return requested.join(active(reservations, now).select("entity").distinct(), "entity", "left_semi")
