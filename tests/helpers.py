"""Evaluate a column on a handful of text values."""


def on_values(spark, values, build):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", build(F.col("v")).alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["i"])]
