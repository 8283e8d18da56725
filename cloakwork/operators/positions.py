"""Row numbers, ranks and neighbours that hold when one group has a large share of all rows.

A plain window puts each partition key into one task. Here the frame is range-sorted once on (group, order), so a
hot group spreads over many tasks; the sorted copy goes to reliable storage, and the row number is the place inside
a sorted partition plus the size of the partitions before it (one small row per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.session import cut

LOW_BITS = (1 << 33) - 1  # place inside a partition in monotonically_increasing_id

Order = str | Column


def as_columns(order: Sequence[Order]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_sequence(df: DataFrame, order: Sequence[Order], name: str = "seq_no", start: int = 1) -> DataFrame:
    """Gap-free running number in the given order, without a single-task window."""
    placed = cut(df.orderBy(*as_columns(order)).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    place = F.col("_mid").bitwiseAND(F.lit(LOW_BITS))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_rows"))
    running = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_part", F.coalesce(running, F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + place + F.lit(start))
        .drop("_mid", "_part", "_before")
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[Order], name: str = "row_number") -> DataFrame:
    """``row_number`` inside each group plus ``group_rows``. The order should be unique to be repeatable."""
    if not group:
        numbered = with_sequence(df, order, name)
        return numbered.withColumn("group_rows", F.lit(numbered.count()))
    placed = with_sequence(df, [*group, *order], "_at")
    spans = placed.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("group_rows")
    )
    match = [_same(g, f"_g_{g}") for g in group]
    return (
        placed.join(spans, match)
        .withColumn(name, F.col("_at") - F.col("_first") + 1)
        .drop("_first", "_at", *[f"_g_{g}" for g in group])
    )


def ranks(df: DataFrame, group: Sequence[str], value: str, ascending: bool = True) -> DataFrame:
    """Adds ``rank`` and ``dense_rank`` of a column in its group: counts per distinct value, then running sums."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_ties"))
    order = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
    dense = group_positions(counts, group, [order], "dense_rank").drop("group_rows")
    table = running_total(dense, group, "dense_rank", "_ties", "_upto")
    table = table.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col(value).alias("_value"), "dense_rank",
        (F.col("_upto") - F.col("_ties") + 1).alias("rank"),
    )
    match = [_same(g, f"_g_{g}") for g in group] + [_same(value, "_value")]
    return df.join(table, match).drop("_value", *[f"_g_{g}" for g in group])


STRIDE = 4096  # neighbouring rows that share a block when running totals or neighbours are made


def running_total(df: DataFrame, group: Sequence[str], place: str, amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` by a gap-free ``place`` (from 1) in each group, in blocks of bounded size.

    What the blocks before a block sum to is a running total again, over their sums, so a group of any size is in no one task.
    """
    blocked = df.withColumn("_block", F.floor((F.col(place) - 1) / STRIDE))
    inner = Window.partitionBy(*group, "_block").orderBy(place)
    sums = blocked.groupBy(*group, "_block").agg(F.sum(amount).alias("_sum"))
    most = df.agg(F.max(place)).first()[0] or 0
    if most <= STRIDE * STRIDE:
        outer = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = sums.withColumn("_total", F.sum("_sum").over(outer))
    else:
        numbered = sums.withColumn("_number", F.col("_block") + 1).withColumnRenamed("_block", "_own")
        totals = running_total(numbered, group, "_number", "_sum", "_total").withColumnRenamed("_own", "_block")
    before = totals.select(
        *[F.col(g).alias(f"_b_{g}") for g in group], F.col("_block").alias("_b_block"),
        (F.coalesce(F.col("_total"), F.lit(0)) - F.coalesce(F.col("_sum"), F.lit(0))).alias("_base"),
    )
    match = [_same(g, f"_b_{g}") for g in group] + [F.col("_block") == F.col("_b_block")]
    return (
        blocked.withColumn("_inner", F.sum(amount).over(inner))
        .join(before, match)
        .withColumn(name, F.col("_inner") + F.col("_base"))
        .drop("_block", "_inner", "_base", "_b_block", *[f"_b_{g}" for g in group])
    )


def ntile(df: DataFrame, group: Sequence[str], order: Sequence[Order], tiles: int, name: str = "ntile") -> DataFrame:
    """Tile 1..n of each row: the first (rows mod n) tiles hold one row more."""
    placed = group_positions(df, group, order, "_rn")
    size, extra = F.floor(F.col("group_rows") / tiles), F.col("group_rows") % tiles
    big = extra * (size + 1)
    tile = F.when(F.col("_rn") <= big, F.floor((F.col("_rn") - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((F.col("_rn") - 1 - big) / F.greatest(size, F.lit(1))) + 1
    )
    return placed.withColumn(name, tile.cast("int")).drop("_rn", "group_rows")


def neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[Order], column: str, back: int = 1, ahead: int = 1
) -> DataFrame:
    """``lag_<column>`` and ``lead_<column>`` by one range sort, with no self-join and no group in one task.

    The sorted rows are numbered through and dealt to blocks of STRIDE; the first and last rows of a block go to the block beside
    it too, so every row finds its neighbours in its own block, and a neighbour of another group counts as none.
    """
    stride = max(STRIDE, back, ahead)
    placed = with_sequence(df, [*group, *order], "_at", 0)
    block, place = F.floor(F.col("_at") / stride), F.col("_at") % stride
    wanted = F.array_compact(
        F.array(block, F.when(place >= stride - back, block + 1), F.when((place < ahead) & (block > 0), block - 1))
    )
    dealt = placed.withColumn("_own", block).withColumn("_block", F.explode(wanted))
    window = Window.partitionBy("_block").orderBy("_at")
    entry = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(column).alias("value"))

    def beside(found: str) -> Column:
        same = F.col(found).isNotNull()
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(found)[f"g{i}"])
        return F.when(same, F.col(found)["value"])

    seen = dealt.select("*", F.lag(entry, back).over(window).alias("_lag"), F.lead(entry, ahead).over(window).alias("_lead")).where("_own = _block")
    return seen.select(*df.columns, beside("_lag").alias(f"lag_{column}"), beside("_lead").alias(f"lead_{column}"))


def top_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Order], rows: int, name: str = "rank_in_group"
) -> DataFrame:
    """First rows of each group. Spark limits each group before the shuffle, so a hot group stays small."""
    window = Window.partitionBy(*group).orderBy(*as_columns(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= rows)
