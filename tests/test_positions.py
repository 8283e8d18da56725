"""Neighbours and running totals over a hot group and many blocks, beside plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cloakwork.operators import positions as pos


def rows(spark, n=500):
    draw = random.Random(2)
    made = [(draw.choice(["hot"] * 8 + ["a", "b", None]), i, draw.choice([None, draw.randrange(50)])) for i in range(n)]
    return spark.createDataFrame([*made, ("lone", n, 7)], "g string, i int, v int").repartition(4)


@pytest.mark.parametrize("stride, back, ahead", [(7, 1, 1), (7, 2, 3), (7, 9, 20), (4096, 1, 2), (1, 1, 1)])
def test_neighbours_as_by_a_window(spark, monkeypatch, stride, back, ahead):
    monkeypatch.setattr(pos, "STRIDE", stride)
    w = Window.partitionBy("g").orderBy("i")
    want = rows(spark).select("g", "i", "v", F.lag("v", back).over(w).alias("lag_v"), F.lead("v", ahead).over(w).alias("lead_v"))
    got = pos.neighbours(rows(spark), ["g"], ["i"], "v", back, ahead)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_neighbours_without_groups_or_rows(spark):
    got = pos.neighbours(rows(spark), [], ["i"], "v").orderBy("i").collect()
    assert [r["lag_v"] for r in got[1:]] == [r["v"] for r in got[:-1]]
    assert pos.neighbours(rows(spark).limit(0), ["g"], ["i"], "v").count() == 0


@pytest.mark.parametrize("stride", [2, 5, 4096])
def test_running_totals_of_totals(spark, monkeypatch, stride):
    monkeypatch.setattr(pos, "STRIDE", stride)
    w = Window.partitionBy("g").orderBy("i")
    numbered = rows(spark, 120).withColumn("n", F.row_number().over(w))
    want = numbered.select("g", "i", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("t"))
    got = pos.running_total(numbered.fillna(0, ["v"]), ["g"], "n", "v", "t").select("g", "i", "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
