"""Synthetic generation; row counts and profiles come from the given tables."""

import datetime as dt

from pyspark.sql import functions as F

from cloakwork.functions import generators as gen
from cloakwork.functions.generators import Source, Spec
from cloakwork.functions.keyed import MaskKey, iban_valid, luhn_valid
from cloakwork.operators import checks as chk
from cloakwork.operators import synthesis as syn
from cloakwork.operators.subset import Edge
from cloakwork.operators.synthesis import Check, Col, Table
from cloakwork.plans import sqltext as sql
from cloakwork.functions import wordlists as words
from cloakwork.plans.keys import KEY
from cloakwork.plans.registry import query
from cloakwork.session import scratch_path, spread, task_count

GEN = MaskKey("synthetic", "7")


def d(column, row, place, bound):
    return sql.draw(sql.draws(GEN, f"gen|{column}", f"{row}::VARCHAR"), place, bound)


def rows_of(t):
    """One synthetic row per customer, numbered by its key."""
    return t.customer.select((F.col("c_custkey") + 1).alias("row"))


def generated(t, namespace, specs):
    rows = rows_of(t)
    return rows.select("row", *[gen.generate(s, Source(GEN, f"{namespace}.{n}"), F.col("row")).alias(n) for n, s in specs.items()])


R = "(SELECT c_custkey + 1 AS row FROM customer)"
FIRST = sql.name_at(words.FIRST_HEADS, words.FIRST_TAILS, d("p.first", "row", 0, words.FIRST_SIZE))
LAST = sql.name_at(words.LAST_HEADS, words.LAST_TAILS, d("p.last", "row", 1, words.LAST_SIZE))


@query("generate_names", f"SELECT row, {FIRST} AS first, {LAST} AS last FROM {R}")
def names(t):
    return generated(t, "p", {"first": Spec("FIRST_NAME"), "last": Spec("LAST_NAME")})


@query(
    "generate_people",
    f"SELECT row, (18 + {d('p.age', 'row', 0, 62)})::VARCHAR AS age, (['M','F','X'])[{d('p.gender', 'row', 0, 3)} + 1] AS gender, "
    f"CASE WHEN {d('p.gw', 'row', 0, 100)} < 30 THEN 'F' ELSE 'M' END AS gw FROM {R}",
)
def people(t):
    return generated(t, "p", {"age": Spec("AGE"), "gender": Spec("GENDER"), "gw": Spec("GENDER_WEIGHTED", "F:30|M:70")})


@query(
    "generate_contact_shapes",
    "SELECT count(*) AS n_rows, count(*) AS phones, count(*) AS distinct_phones, count(*) AS ssns, count(*) AS emails, count(*) AS adults FROM customer",
)
def contacts(t):
    out = generated(t, "p", {"phone": Spec("PHONE_US"), "ssn": Spec("SSN"), "email": Spec("EMAIL"), "dob": Spec("DOB_ADULT")})
    return out.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("phone").rlike(r"^\([2-9]\d{2}\) 555-01\d{2}( x[1-9]\d*)?$")).alias("phones"),
        F.count_distinct("phone").alias("distinct_phones"), F.count_if(chk.looks_real("SSN", F.col("ssn"))).alias("ssns"),
        F.count_if(F.col("email").rlike(r"^[a-z]+\.[a-z]+\d+@[a-z-]+\.test$")).alias("emails"),
        F.count_if(F.col("dob").cast("date") <= F.lit(dt.date(2006, 1, 1))).alias("adults"),
    )


@query(
    "generate_unique_cards",
    " UNION ALL ".join(f"SELECT '{n}' AS network, count(*) AS n_rows, count(*) AS valid, count(*) AS distinct_cards FROM orders" for n in gen.CARDS),
)
def cards(t):
    numbered = t.orders.select((F.col("o_orderkey") + 1).alias("row"))
    rows = spread(numbered)
    pairs = [F.struct(F.lit(n).alias("network"), gen.card_number(Source(GEN, f"c.{n}"), F.col("row"), n).alias("card"), F.lit(len_).alias("size")) for n, (_, len_) in gen.CARDS.items()]
    flat = rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    # no card repeats, so a task holds all cards it counts: their number per task must not grow with the table
    dealt = flat.repartition(task_count(numbered), "network", "card")
    counted = dealt.groupBy("network", "size", "card").agg(F.count("*").alias("n"))
    return counted.groupBy("network").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(luhn_valid(F.col("card")) & (F.length("card") == F.col("size")), F.col("n")).otherwise(0)).alias("valid"),
        F.count("*").alias("distinct_cards"),
    )


@query(
    "generate_bank_values",
    f"SELECT count(*) AS n_rows, count(*) AS accounts, count(*) AS routing, count(*) AS bics, count(*) AS scores, count(*) AS amounts FROM customer",
)
def bank(t):
    out = generated(t, "b", {"acct": Spec("ACCOUNT_NUMBER"), "aba": Spec("ROUTING_NUMBER_US"), "bic": Spec("BIC"), "score": Spec("RISK_SCORE"), "usd": Spec("CURRENCY_USD", "500")})
    return out.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("acct").rlike(r"^\d{12}$")).alias("accounts"), F.count_if(chk.routing_valid(F.col("aba"))).alias("routing"),
        F.count_if(F.col("bic").rlike("^[A-Z]{4}DE[A-Z]{2}$")).alias("bics"), F.count_if(F.col("score").cast("double").between(0, 1)).alias("scores"),
        F.count_if(F.col("usd").cast("double").between(1, 500)).alias("amounts"),
    )


@query(
    "generate_times",
    f"SELECT row, (DATE '2024-01-01' - {d('t.recent', 'row', 0, 365)}::INT)::VARCHAR AS recent, (DATE '2024-01-01' + (1 + {d('t.future', 'row', 0, 365)})::INT)::VARCHAR AS future, "
    f"(DATE '2020-01-01' + {d('t.between', 'row', 0, 366)}::INT)::VARCHAR AS between_days, "
    f"strftime(TIMESTAMP '2024-01-01' - to_minutes({d('t.stamp', 'row', 0, 1440)}), '%Y-%m-%dT%H:%M:%S') AS stamp FROM {R}",
)
def times(t):
    out = generated(t, "t", {"recent": Spec("DATE_RECENT"), "future": Spec("DATE_FUTURE"), "between": Spec("DATE_BETWEEN", "2020-01-01", "2020-12-31"), "stamp": Spec("TIMESTAMP_RECENT")})
    return out.withColumnRenamed("between", "between_days")


CITY = f"({sql.listing(words.CITIES)})[(row - 1) % {len(words.CITIES)} + 1]"


@query(
    "generate_places",
    f"SELECT row, split_part({CITY}, ',', 1) AS city, split_part({CITY}, ',', 2) AS state, split_part({CITY}, ',', 3) AS zip, "
    f"split_part(({sql.listing(gen.PLACES['GB'])})[(row - 1) % 4 + 1], ',', 1) AS abroad, 'GB' AS country FROM {R}",
)
def places(t):
    return generated(t, "g", {"city": Spec("CITY"), "state": Spec("STATE"), "zip": Spec("ZIP"), "abroad": Spec("CITY_BY_COUNTRY", "GB"), "country": Spec("COUNTRY_CODE", "gb")})


@query(
    "generate_business_values",
    f"SELECT row, {sql.listing(words.COMPANIES)}[{d('s.company', 'row', 0, len(words.COMPANIES))} + 1] AS company, {sql.listing(gen.ORDER_STATES)}[{d('s.state', 'row', 0, 6)} + 1] AS state, "
    f"{sql.listing(gen.LOREM)}[{d('s.word', 'row', 0, len(gen.LOREM))} + 1] AS word FROM {R}",
)
def business(t):
    return generated(t, "s", {"company": Spec("COMPANY"), "state": Spec("ORDER_STATUS"), "word": Spec("LOREM_WORD")})


@query(
    "generate_keys_and_constants",
    f"SELECT row, 'K' || row AS seq, 'P' || lpad(row::VARCHAR, 8, '0') AS padded, 'x' AS fixed, NULL::VARCHAR AS nothing, length('00000000-0000-0000-0000-000000000000') AS uuid_size FROM {R}",
)
def keys(t):
    out = generated(t, "k", {"seq": Spec("SEQUENCE", "K"), "padded": Spec("PADDED_SEQUENCE", "8", "P"), "fixed": Spec("LITERAL", "x"), "nothing": Spec("NULL"), "uuid": Spec("UUID")})
    return out.withColumn("uuid_size", F.length("uuid")).drop("uuid")


@query(
    "generate_numbers_and_text",
    f"SELECT row, (5 + {d('n.int', 'row', 0, 16)})::VARCHAR AS int, {d('n.flag', 'row', 0, 2)} = 1 AS flag, {d('n.likely', 'row', 0, 100)} < 80 AS likely, "
    f"array_to_string(list_transform(range(0, 6), lambda i: substr('abcdefghijklmnopqrstuvwxyz', ((('0x' || substr({sql.draws(GEN, 'gen|n.alpha', 'row::VARCHAR')}, (8 * i + 1)::BIGINT, 8))::UBIGINT::BIGINT % 26) + 1)::BIGINT, 1)), '') AS alpha FROM {R}",
)
def numbers(t):
    out = generated(t, "n", {"int": Spec("INT_RANGE", "5", "20"), "flag": Spec("BOOLEAN"), "likely": Spec("BOOLEAN_WEIGHTED", "80"), "alpha": Spec("ALPHA", "6")})
    return out.withColumns({"flag": F.col("flag").cast("boolean"), "likely": F.col("likely").cast("boolean")})


@query(
    "generate_categories",
    f"SELECT CASE WHEN {d('w.cat', 'row', 0, 10)} < 7 THEN 'A' WHEN {d('w.cat', 'row', 0, 10)} < 9 THEN 'B' ELSE 'C' END AS cat, "
    f"(['on','off'])[{d('w.state', 'row', 0, 2)} + 1] AS state, count(*) AS n FROM {R} GROUP BY ALL",
)
def categories(t):
    return generated(t, "w", {"cat": Spec("WEIGHTED", "A:7|B:2|C:1"), "state": Spec("ENUM", "on|off")}).groupBy("cat", "state").agg(F.count("*").alias("n"))


@query(
    "generate_normal_distribution",
    "SELECT count(*) AS n_rows, true AS mean_near, true AS spread_near FROM lineitem",
)
def bell(t):
    rows = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    value = gen.generate(Spec("NORMAL_DECIMAL", "50", "10"), Source(GEN, "z.v"), F.col("row")).cast("double")
    return rows.agg(F.count("*").alias("n_rows"), F.avg(value).between(49, 51).alias("mean_near"), F.stddev_samp(value).between(9.5, 10.5).alias("spread_near"))


@query(
    "generate_network_values",
    f"SELECT row, {sql.listing(gen.HTTP_CODES)}[{d('i.http', 'row', 0, 10)} + 1] AS http, '10.' || {d('i.v4', 'row', 0, 256)} || '.' || {d('i.v4', 'row', 1, 256)} || '.' || (1 + {d('i.v4', 'row', 2, 254)}) AS v4, "
    f"'https://' || {sql.listing(words.SAFE_DOMAINS)}[{d('i.url', 'row', 0, len(words.SAFE_DOMAINS))} + 1] || '/shop' AS url FROM {R}",
)
def network(t):
    return generated(t, "i", {"http": Spec("HTTP_STATUS"), "v4": Spec("IPV4"), "url": Spec("URL", "/shop")})


def shop(t, seed="7", store=None):
    """Customers, accounts and transfers as many as the given customers and orders."""
    customers, orders = t.customer.count(), t.orders.count()
    tables = [
        Table("customers", customers, [
            Col("id", "SEQUENCE", type="bigint"), Col("name", "FULL_NAME"), Col("mail", "TEMPLATE", "${name:slug}@${domain}", unique=True),
            Col("tier", "ENUM", "gold|silver"), Col("discount", "CASE", "tier", "gold=10|*=0", type="int"),
            Col("score", "NORMAL_INT", "50", "40", type="int", check=Check(low="0", high="100")),
            Col("boss", refers=("customers", "id"), type="bigint"),
        ]),
        Table("accounts", customers * 3, [
            Col("no", "PADDED_SEQUENCE", "10", "AC"), Col("ccy", "ENUM", "USD|EUR|GBP", check=Check(values=("USD", "EUR"))),
            Col("owner", refers=("customers", "id"), type="bigint", fewest=1, most=5), Col("opened", "DATE_BETWEEN", "2020-01-01", "2020-06-30", type="date"),
            Col("closed", "DATE_AFTER", "opened", "90", type="date"), Col("owner_mail", "LOOKUP", "owner", "mail"), Col("alias", "COPY", "no", "lower"),
        ]),
        Table("transfers", orders, [
            Col("id", "UUID"), Col("account", refers=("accounts", "no"), group="acc"), Col("ccy", refers=("accounts", "ccy"), group="acc"),
            Col("amount", "DECIMAL_RANGE", "-50", "900", type="decimal(12,2)", check=Check(low="0")),
        ]),
    ]
    return syn.Generator(t.spark, tables, seed, store=store).run()


EDGES = [Edge("customers", "boss", "customers", "id"), Edge("accounts", "owner", "customers", "id"), Edge("transfers", "account", "accounts", "no")]


@query(
    "generate_relational_evidence",
    "SELECT 'rows' AS measure, 'customers' AS subject, count(*) AS amount FROM customer UNION ALL SELECT 'rows', 'accounts', 3 * count(*) FROM customer UNION ALL SELECT 'rows', 'transfers', count(*) FROM orders "
    "UNION ALL SELECT 'nulls', 'customers', 1 FROM (SELECT count(*) FROM customer) UNION ALL SELECT * FROM (VALUES ('nulls', 'accounts', 0), ('nulls', 'transfers', 0), ('repeated', 'customers.id', 0), ('repeated', 'customers.mail', 0), "
    "('repeated', 'accounts.no', 0), ('repeated', 'transfers.id', 0), ('orphans', 'customers.boss', 0), ('orphans', 'accounts.owner', 0), ('orphans', 'transfers.account', 0))",
)
def evidence(t):
    return syn.load_evidence(shop(t, store=scratch_path(t.spark, "shop")), EDGES, {"customers": ["id", "mail"], "accounts": ["no"], "transfers": ["id"]})


@query("generate_children_bounds", "SELECT true AS at_least_one, true AS at_most_five, true AS they_vary, count(*) AS parents, 3 * count(*) AS children FROM customer")
def bounds(t):
    """Every parent has one to five children, three on average, and not all the same number."""
    per = shop(t)["accounts"].groupBy("owner").agg(F.count("*").alias("n"))
    return per.agg(
        (F.min("n") >= 1).alias("at_least_one"), (F.max("n") <= 5).alias("at_most_five"), (F.count_distinct("n") > 1).alias("they_vary"),
        F.count("*").alias("parents"), F.sum("n").alias("children"),
    )


@query("generate_composite_key", "SELECT count(*) AS n_rows, 0 AS mismatched FROM orders")
def composite(t):
    out = shop(t)
    parents = out["accounts"].select(F.col("no").alias("account"), F.col("ccy").alias("parent_ccy"))
    joined = out["transfers"].join(parents, "account")
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("ccy") != F.col("parent_ccy")).alias("mismatched"))


@query("generate_self_reference", "SELECT count(*) AS n_rows, 1 AS roots, 0 AS later FROM customer")
def self_reference(t):
    return shop(t)["customers"].agg(F.count("*").alias("n_rows"), F.count_if(F.col("boss").isNull()).alias("roots"), F.count_if(F.col("boss") >= F.col("id")).alias("later"))


@query("generate_derived_columns", "SELECT 3 * count(*) AS n_rows, 3 * count(*) AS after_open, 3 * count(*) AS mails, 3 * count(*) AS aliases FROM customer")
def derived(t):
    out = shop(t)
    owners = out["customers"].select(F.col("id").alias("owner"), "mail")
    joined = out["accounts"].join(owners, "owner")
    return joined.agg(
        F.count("*").alias("n_rows"), F.count_if(F.datediff("closed", "opened").between(0, 90)).alias("after_open"),
        F.count_if(F.col("owner_mail") == F.col("mail")).alias("mails"), F.count_if(F.upper("alias") == F.col("no")).alias("aliases"),
    )


@query("generate_checks_enforced", "SELECT count(*) AS n_rows, 0 AS broken_scores, 0 AS broken_amounts, 0 AS broken_currency, 0 AS broken_case FROM orders")
def checked(t):
    out = shop(t)
    bad = out["customers"].agg(
        F.count_if(~F.col("score").between(0, 100)).alias("broken_scores"),
        F.count_if(F.col("discount") != F.when(F.col("tier") == "gold", 10).otherwise(0)).alias("broken_case"), F.lit(1).alias("k"),
    )
    currency = out["accounts"].agg(F.count_if(~F.col("ccy").isin("USD", "EUR")).alias("broken_currency"), F.lit(1).alias("k"))
    amounts = out["transfers"].agg(F.count("*").alias("n_rows"), F.count_if(F.col("amount") < 0).alias("broken_amounts"), F.lit(1).alias("k"))
    return amounts.join(bad, "k").join(currency, "k").drop("k")


@query("generate_keys_from_target", "SELECT count(*) AS n_rows, 0 AS orphans, true AS many_parents FROM orders")
def from_target(t):
    rows = t.orders.select((F.col("o_orderkey") + 1).alias("_row"))
    out = syn.existing_keys(rows, t.supplier, "s_suppkey", "supplier", GEN, "x.supplier")
    joined = out.join(t.supplier.select(F.col("s_suppkey").alias("supplier"), F.lit(1).alias("hit")), "supplier", "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("hit").isNull()).alias("orphans"), (F.count_distinct("supplier") > 5).alias("many_parents"))


@query(
    "generate_unique_values",
    "SELECT count(*) AS n_rows, count(*) AS distinct_out, count(DISTINCT p_name) AS kept FROM part",
)
def unique(t):
    """Product names repeat; the first row of each keeps it, the others get their number."""
    rows = t.part.select((F.col("p_partkey") + 1).alias("_row"), F.col("p_name").alias("name"), F.col("p_name").alias("before"))
    out = syn.made_unique(rows, "name")
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct("name").alias("distinct_out"), F.count_if(F.col("name") == F.col("before")).alias("kept"))


@query(
    "generate_unique_planted",
    "SELECT count(*) AS n_rows, count(*) AS texts, count(*) AS numbers, count(*) AS days, 0 AS nulls FROM part",
)
def unique_planted(t):
    """Values that look like repaired ones are planted; numbers and dates stay of their type."""
    row = (F.col("p_partkey") + 1).alias("_row")
    rows = t.part.select(
        row, F.when(F.col("p_partkey") % 3 == 0, "a").otherwise(F.concat(F.lit("a-"), (F.col("p_partkey") + 1 - F.col("p_partkey") % 3).cast("string"))).alias("text"),
        (F.col("p_partkey") % 10).cast("string").alias("number"), F.lit("2024-01-01").alias("day"),
    )
    out = syn.made_unique(syn.made_unique(syn.made_unique(rows, "text"), "number", "int"), "day", "date")
    kinds = out.select("text", F.col("number").try_cast("int").alias("number"), F.col("day").try_cast("date").alias("day"))
    return kinds.agg(
        F.count("*").alias("n_rows"), F.count_distinct("text").alias("texts"), F.count_distinct("number").alias("numbers"),
        F.count_distinct("day").alias("days"), F.count_if(F.col("text").isNull() | F.col("number").isNull() | F.col("day").isNull()).alias("nulls"),
    )


@query(
    "generate_unique_at_the_end_of_a_type",
    "SELECT count(*) AS n_rows, count(*) AS numbers, count(*) AS days, 0 AS outside FROM part",
)
def unique_at_the_end(t):
    """The greatest int and the last day are planted among repeated values: repairs take what is free inside the type."""
    row = (F.col("p_partkey") + 1).alias("_row")
    number = F.when(F.col("p_partkey") % 3 == 0, "2147483647").when(F.col("p_partkey") % 3 == 1, "-2147483648").otherwise("-2147483646")
    day = F.when(F.col("p_partkey") % 2 == 0, "9999-12-31").otherwise("0001-01-02")
    rows = t.part.select(row, number.alias("number"), day.alias("day"))
    out = syn.made_unique(syn.made_unique(rows, "number", "int", KEY), "day", "date", KEY)
    kinds = out.select(F.col("number").try_cast("int").alias("number"), F.col("day").try_cast("date").alias("day"))
    outside = F.col("number").isNull() | F.col("day").isNull() | (F.year("day") > 9999)
    return kinds.agg(
        F.count("*").alias("n_rows"), F.count_distinct("number").alias("numbers"), F.count_distinct("day").alias("days"), F.count_if(outside).alias("outside"),
    )


@query(
    "generate_wide_ranges",
    f"SELECT count(*) AS n_rows, true AS inside, true AS past_32_bits, true AS rarely_repeats FROM {R}",
)
def wide_ranges(t):
    """Ranges that 32 bits cannot fill."""
    out = generated(t, "w", {"big": Spec("INT_RANGE", "0", "1000000000000"), "money": Spec("DECIMAL_RANGE", "0", "1000000000000")})
    big, money = F.col("big").cast("bigint"), F.col("money").cast("decimal(20,2)")
    return out.agg(
        F.count("*").alias("n_rows"), (F.min(big) >= 0).__and__(F.max(big) <= 10**12).alias("inside"),
        (F.max(big) > 2**33).__and__(F.max(money) > 2**33).alias("past_32_bits"), (F.count_distinct(big) > 0.99 * F.count("*")).alias("rarely_repeats"),
    )


@query(
    "profile_lists_all_weights",
    "SELECT count(DISTINCT n_name) AS listed, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def all_weights(t):
    """A column drawn by weight keeps all of its values, as many as count as few."""
    from cloakwork.operators.discovery import recommend

    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("market"))
    weights = F.split("param1", r"\|")
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda s, w: s + F.element_at(F.split(w, ":"), 2).cast("bigint"))
    return recommend(rows).where("generator = 'WEIGHTED'").select(F.size(weights).cast("bigint").alias("listed"), total.alias("total"))


@query("generate_look_alike", "SELECT count(*) AS n_rows, 5 AS segments, count(*) AS distinct_keys, 0 AS source_names FROM customer")
def look_alike(t):
    plan = syn.look_alike(t.customer, "customer", t.customer.count(), ["c_custkey"])
    out = syn.Generator(t.spark, [plan], "7").run()["customer"]
    names = t.customer.select(F.col("c_name").alias("_n"))
    clear = out.join(names, F.col("c_name") == F.col("_n"), "left_semi").agg(F.count("*").alias("source_names"), F.lit(1).alias("k"))
    stats = out.agg(F.count("*").alias("n_rows"), F.count_distinct("c_mktsegment").alias("segments"), F.count_distinct("c_custkey").alias("distinct_keys"), F.lit(1).alias("k"))
    return stats.join(clear, "k").drop("k")
