"""The expression library: strings, numbers, dates, conditions, conversion, aggregates, windows."""

from pyspark.sql import functions as F

from cloakwork.functions import expressions as fx
from cloakwork.operators import mapping as ops
from cloakwork.operators import positions as pos
from cloakwork.plans.registry import query


@query(
    "string_concat_and_case",
    "SELECT s_suppkey, concat(s_name, '/', s_suppkey) AS joined, s_name || '!' AS piped, upper(s_name) AS up, lower(s_name) AS low FROM supplier",
)
def string_case(t):
    return t.supplier.selectExpr(
        "s_suppkey", "concat(s_name, '/', s_suppkey) AS joined", "s_name || '!' AS piped", "upper(s_name) AS up",
        "lower(s_name) AS low",
    )


@query(
    "string_initcap",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS titled FROM part",
)
def string_initcap(t):
    return t.part.selectExpr("p_partkey", "initcap(p_name) AS titled")


@query(
    "string_slice_and_trim",
    "SELECT c_custkey, substring(c_name, 3, 5) AS mid, left(c_name, 4) AS head, right(c_name, 3) AS tail, "
    "trim('  ' || c_name || ' ') AS trimmed, ltrim('  ' || c_name) AS l, rtrim(c_name || '  ') AS r, length(c_name) AS size FROM customer",
)
def string_slice(t):
    return t.customer.selectExpr(
        "c_custkey", "substring(c_name, 3, 5) AS mid", "left(c_name, 4) AS head", "right(c_name, 3) AS tail",
        "trim('  ' || c_name || ' ') AS trimmed", "ltrim('  ' || c_name) AS l", "rtrim(c_name || '  ') AS r",
        "length(c_name) AS size",
    )


@query(
    "string_search_replace_pad",
    "SELECT p_partkey, replace(p_name, ' ', '_') AS swapped, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '*') AS r, "
    "instr(p_name, 'bolt') AS at_place, regexp_replace(p_name, '[aeiou]', '#', 'g') AS vowels, split_part(p_name, ' ', 2) AS second FROM part",
)
def string_search(t):
    return t.part.selectExpr(
        "p_partkey", "replace(p_name, ' ', '_') AS swapped", "lpad(p_brand, 12, '*') AS l", "rpad(p_brand, 12, '*') AS r",
        "locate('bolt', p_name) AS at_place", "regexp_replace(p_name, '[aeiou]', '#') AS vowels",
        "split_part(p_name, ' ', 2) AS second",
    )


@query(
    "numeric_functions",
    "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, "
    "power(c_nationkey, 2) AS p, round(sqrt(c_nationkey), 6) AS s, sign(c_acctbal) AS g, greatest(c_acctbal, 500) AS big, least(c_acctbal, 500) AS small, "
    "CAST(trunc(CAST(c_acctbal AS DECIMAL(14,2)) * 10) AS DOUBLE) / 10 AS t FROM customer",
)
def numeric_functions(t):
    exact = F.col("c_acctbal").cast("decimal(14,2)")
    return t.customer.select(
        "c_custkey", F.abs("c_acctbal").alias("a"), F.ceil("c_acctbal").alias("c"), F.floor("c_acctbal").alias("f"),
        (F.col("c_custkey") % 7).alias("m"), F.pow("c_nationkey", F.lit(2)).alias("p"),
        F.round(F.sqrt("c_nationkey"), 6).alias("s"), F.signum("c_acctbal").alias("g"),
        F.greatest("c_acctbal", F.lit(500.0)).alias("big"), F.least("c_acctbal", F.lit(500.0)).alias("small"),
        fx.truncate(exact, 1).cast("double").alias("t"),
    )


@query(
    "date_parts_and_truncation",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, "
    "current_date >= DATE '2024-01-01' AS later FROM orders",
)
def date_parts(t):
    return t.orders.selectExpr(
        "o_orderkey", "cast(date_trunc('month', o_orderdate) as date) AS month_start",
        "extract(year from o_orderdate) AS y", "month(o_orderdate) AS m", "day(o_orderdate) AS d",
        "current_date() >= date'2024-01-01' AS later",
    )


@query(
    "date_arithmetic",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) AS plus_months, CAST(o_orderdate AS DATE) + 30 AS plus_days, "
    "date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days, last_day(CAST(o_orderdate AS DATE)) AS month_end, "
    "strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d')::DATE AS reparsed, "
    "12 * (2002 - year(o_orderdate)) + 1 - month(o_orderdate) AS whole_months FROM orders",
)
def date_arithmetic(t):
    return t.orders.selectExpr(
        "o_orderkey", "add_months(cast(o_orderdate as date), 2) AS plus_months",
        "date_add(cast(o_orderdate as date), 30) AS plus_days",
        "datediff(date'2002-01-01', cast(o_orderdate as date)) AS days",
        "last_day(cast(o_orderdate as date)) AS month_end",
        "to_date(date_format(o_orderdate, 'yyyy/MM/dd'), 'yyyy/MM/dd') AS reparsed",
        "cast(months_between(date'2002-01-01', trunc(cast(o_orderdate as date), 'MM')) as int) AS whole_months",
    )


@query(
    "conditional_functions",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS decoded, "
    "nullif(o_orderstatus, 'P') AS nulled, coalesce(nullif(o_orderstatus, 'P'), 'none') AS nvl1, "
    "CASE WHEN nullif(o_orderstatus, 'P') IS NOT NULL THEN 'some' ELSE 'none' END AS nvl2, "
    "CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS iif FROM orders",
)
def conditionals(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select(
        "o_orderkey", fx.decode_value(F.col("o_orderstatus"), "O", "open", "F", "filled", "other").alias("decoded"),
        status.alias("nulled"), F.nvl(status, F.lit("none")).alias("nvl1"),
        F.nvl2(status, F.lit("some"), F.lit("none")).alias("nvl2"),
        F.expr("if(o_totalprice > 200000, 'big', 'small')").alias("iif"),
    )


@query(
    "conversion_functions",
    "SELECT event_id, CAST(value AS DECIMAL(12,2))::VARCHAR AS as_text, TRY_CAST(event_type AS INTEGER) AS no_number, "
    "TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(CAST(trim(regexp_extract(props, '[0-9]+')) AS DECIMAL(12,2)) AS DOUBLE) AS num, "
    "strftime(ts, '%Y%m%d') AS day_text FROM events",
)
def conversions(t):
    return t.events.select(
        "event_id", fx.text_of_number(F.col("value"), 2).alias("as_text"),
        F.col("event_type").try_cast("int").alias("no_number"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("int").alias("k"),
        fx.number_of_text(F.regexp_extract("props", "[0-9]+", 0)).cast("double").alias("num"),
        F.date_format("ts", "yyyyMMdd").alias("day_text"),
    )


@query(
    "aggregate_functions",
    "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, CAST(sum(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) AS total, "
    "round(CAST(sum(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) / count(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high, round(stddev_samp(c_acctbal), 4) AS spread FROM customer GROUP BY 1",
)
def aggregates(t):
    return t.customer.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("nations"),
        F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("double").alias("total"),
        F.round(F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("double") / F.count("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"),
        F.round(F.stddev_samp("c_acctbal"), 4).alias("spread"),
    )


@query(
    "string_aggregate_ordered",
    "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1",
)
def string_aggregate(t):
    return ops.string_aggregate(t.lineitem, ["l_suppkey"], "l_returnflag", "flags")


@query(
    "ranking_windows",
    "SELECT event_id, row_number() OVER w AS row_number, rank() OVER (PARTITION BY event_type ORDER BY value) AS rank, "
    "dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS dense_rank, ntile(4) OVER w AS ntile FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)",
)
def ranking(t):
    rows = t.events.select("event_id", "event_type", "value")
    tiled = pos.ntile(rows, ["event_type"], ["value", "event_id"], 4)
    numbered = pos.group_positions(tiled, ["event_type"], ["value", "event_id"]).drop("group_rows")
    return pos.ranks(numbered, ["event_type"], "value").select("event_id", "row_number", "rank", "dense_rank", "ntile")


@query(
    "offset_windows",
    "SELECT event_id, lag(value) OVER w AS lag_value, lead(value) OVER w AS lead_value FROM events "
    "WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)",
)
def offsets(t):
    rows = t.events.select("event_id", "event_type", "ts", "value")
    return pos.neighbours(rows, ["event_type"], ["ts", "event_id"], "value").select("event_id", "lag_value", "lead_value")
