"""Lines that many documents share: exploded, hashed, counted by document, dropped, and the rest put together again by position."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.license_scan import LOWER, UPPER
from cloakwork.session import scratch_path

SPACE = "\t\n\x0b\x0c\r "
HOT_LINES = 1000  # the lines of most documents, broadcast; any other is in a thousandth of the rows at most


def line_key(line: Column) -> Column:
    """The line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _without(lines: Column, places: Column) -> Column:
    """The lines but those at the sorted places: the stretches between neighbouring places, in one walk."""
    ends = F.concat(places, F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b)))


def drop_shared_lines(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_column, n_lines, n_dropped, text`` with the text that is left.

    A text is split at each newline. A line's key (``line_key``) is counted where it has ``least_chars`` code points; if
    ``least_docs`` documents or more hold it, all its lines go except in the document of the largest id. Keys are compared by two
    64-bit hashes. A document is an (id, text): rows that repeat one count once and lose alike; of rows that share the largest id
    each keeps its lines. Null ids are smaller than all others: a key that only such rows hold stays in all of them. Null and
    empty texts are one empty line; a text that loses all its lines is empty. An empty table gives no rows; other columns are
    ignored, whatever their names.

    Shuffled are hashes of lines (never the lines), the texts once, and the places to be dropped. Counts are summed on the map
    side; to tell the lines that go, the HOT_LINES most frequent keys are broadcast and only the others are joined by hash, so
    that a line which a third of the documents hold is no hot key.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    lines = rows.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).withColumn("key", line_key(F.col("line")))
    keys = ["h1", "h2"]
    hashed = lines.where(F.char_length("key") >= least_chars).select("id", "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    folder = scratch_path(spark, "lines")
    hashed.write.parquet(os.path.join(folder, "hashed"))  # read three times below
    hashed = spark.read.parquet(os.path.join(folder, "hashed"))
    holders = hashed.select(*keys, "id", "mark").distinct()  # spread by document too: no hot line here
    counted = holders.groupBy(*keys).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    counted.where(F.col("n") >= least_docs).write.parquet(os.path.join(folder, "shared"))
    shared = spark.read.parquet(os.path.join(folder, "shared"))
    hot = shared.orderBy(F.desc("n"), *keys).limit(HOT_LINES)
    flag = F.lit(True).alias("hot")
    marked = hashed.join(F.broadcast(hot.select(*keys, "last", flag)), keys, "left")
    others = shared.join(F.broadcast(hot.select(*keys, flag)), keys, "left_anti")
    rare = marked.where("hot IS NULL").drop("last", "hot").join(others.select(*keys, "last"), keys)
    gone = marked.where("hot").drop("hot").unionByName(rare).where(~F.col("id").eqNullSafe(F.col("last")))
    places = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"))
    joined = rows.alias("r").join(
        places.alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.mark") == F.col("p.mark")), "left"
    ).select(F.col("r.id").alias("id"), F.split("r.text", "\n", -1).alias("lines"), F.col("r.text").alias("text"), "places")
    return joined.select(
        F.col("id").alias(id_column), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("places")), "\n")).alias("text"),
    )


def brute_force_sql(least_chars: int = 40, least_docs: int = 5) -> str:
    """The query's rows in DuckDB, line by line."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM cut),
    keyed AS (SELECT *, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS key FROM lines),
    shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {least_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {least_docs}),
    told AS (SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id <> s.last, false) AS gone FROM keyed k LEFT JOIN shared s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM told GROUP BY doc_id"""
