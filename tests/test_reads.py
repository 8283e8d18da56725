"""Tables are read a fixed number of times, whatever their rows need: each pass over a joined table counts at size."""

from pyspark.sql import functions as F

from cloakwork.functions.keyed import MaskKey
from cloakwork.operators import entities as ent
from cloakwork.operators import synthesis as syn


def counted(df):
    """The frame and a counter of the rows that jobs read of it."""
    reads = df.sparkSession.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            reads.add(part.num_rows)
            yield part

    return df.mapInArrow(run, df.schema), reads


def test_crowded_parts_are_cut_without_reading_all_rows_again(spark):
    """Thirty equal rows of one key make a part too large; the other keys' rows are read for sizes, parts and fragments only."""
    some = spark.range(2_000).select((F.col("id") % 20).alias("k"), F.col("id").alias("n"))
    frame, reads = counted(some.unionByName(spark.range(30).select(F.lit(0).cast("long").alias("k"), F.lit(7).cast("long").alias("n"))).repartition(4))
    parts = ent.fragments([ent.Member("m", frame, "k")], 20)
    got = parts.select("entity", "n_rows", "rows").collect()
    assert sum(r["n_rows"] for r in got) == sum(len(r["rows"]) for r in got) == 2_030 and max(r["n_rows"] for r in got) <= 20
    assert reads.value <= 5 * 2_030


def test_repairs_read_their_rows_a_few_times(spark):
    """The second column's repair starts from kept rows: it does not repeat the first one's joins."""
    rows, reads = counted(spark.range(1, 301).select(F.col("id").alias("_row"), F.lit("2147483647").alias("number"), F.lit("9999-12-31").alias("day")))
    key = MaskKey("test-secret")
    out = syn.made_unique(syn.made_unique(rows, "number", "int", key), "day", "date", key)
    assert out.select("number").distinct().count() == out.select("day").distinct().count() == 300
    assert reads.value <= 8 * 300
