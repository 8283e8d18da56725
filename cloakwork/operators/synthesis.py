"""Relational synthetic data: tables from a plan, keys that match, unique values, checks, load evidence.

Every base column is a function of its row number, so the key of a drawn parent is computed in place from the
parent's row number: foreign keys, self references and look-ups of plain columns need no join and no shuffle.
Only a parent column that was changed afterwards (made unique, derived) is fetched by an equi-join on the row.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import generators as gen
from cloakwork.functions.generators import Source, Spec
from cloakwork.functions.keyed import MaskKey
from cloakwork.functions.numbers import permuted
from cloakwork.operators.discovery import recommend
from cloakwork.operators.subset import Edge, referenced_first
from cloakwork.session import cut

DERIVED = {"TEMPLATE", "COPY", "CASE", "DATE_AFTER", "LOOKUP"}


@dataclass(frozen=True)
class Check:
    """Enforceable CHECK: a list of values, or a lower and an upper bound."""

    values: tuple[str, ...] = ()
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Col:
    """Column of a plan. ``refers`` is (table, column); ``fewest``/``most`` bound the children per parent."""

    name: str
    generator: str = "ALPHANUMERIC"
    p1: str | None = None
    p2: str | None = None
    type: str = "string"
    refers: tuple[str, str] | None = None
    fewest: int | None = None
    most: int | None = None
    unique: bool = False
    check: Check | None = None
    group: str | None = None  # columns of one composite key share a group, so they use the same parent row


@dataclass(frozen=True)
class Table:
    name: str
    rows: int
    columns: Sequence[Col] = field(default_factory=list)


def check_of(text: str) -> tuple[str, Check] | None:
    """``col IN (..)``, ``col BETWEEN a AND b`` or ``col >= n`` as a rule; anything else is evidence only."""
    body = re.sub(r"(?i)^\s*check\s*", "", text).strip().strip("()").strip()
    found = re.fullmatch(r"(?i)(\w+)\s+in\s*\(?(.*?)\)?", body)
    if found:
        return found.group(1), Check(values=tuple(v.strip().strip("'") for v in found.group(2).split(",")))
    found = re.fullmatch(r"(?i)(\w+)\s+between\s+(-?[\d.]+)\s+and\s+(-?[\d.]+)", body)
    if found:
        return found.group(1), Check(low=found.group(2), high=found.group(3))
    found = re.fullmatch(r"(\w+)\s*(>=|<=|>|<)\s*(-?[\d.]+)", body)
    if found:
        name, op, number = found.groups()
        if "=" not in op:
            places = len(number.partition(".")[2])
            step = 10.0**-places
            number = f"{float(number) + (step if op == '>' else -step):.{places}f}"
        return name, Check(low=number) if op.startswith(">") else Check(high=number)
    return None


def enforced(value: Column, check: Check, row: Column) -> Column:
    """Value moved into its CHECK: list members by row, numbers clamped."""
    if check.values:
        other = gen.at(list(check.values), (row - 1) % len(check.values))
        return F.when(value.isin(*check.values) | value.isNull(), value).otherwise(other)
    number = value.try_cast("decimal(28,8)")
    out = value
    for bound, fits in ((check.low, lambda a, b: a >= b), (check.high, lambda a, b: a <= b)):
        if bound is not None:
            out = F.when(number.isNull() | fits(number, F.lit(bound).cast("decimal(28,8)")), out).otherwise(F.lit(bound))
    return out


class Generator:
    """Generates the tables of a plan, parents first. With a ``store`` each table is written there once and read back, so what
    is derived from it or checked on it later does not generate it anew."""

    def __init__(
        self, spark: SparkSession, tables: Sequence[Table], seed: str = "0", now: dt.datetime = gen.EPOCH, store: str | None = None
    ):
        self.spark, self.now, self.store = spark, now, store
        self.key = MaskKey("synthetic", seed)
        self.tables = {t.name: t for t in tables}
        self.done: dict[str, DataFrame] = {}
        for table in tables:
            self._check_plan(table)

    def _check_plan(self, table: Table) -> None:
        for c in table.columns:
            network = c.generator.upper().removeprefix("CREDIT_CARD_")
            if network in gen.CARDS and table.rows > gen.card_capacity(network):
                raise ValueError(f"{table.name}.{c.name}: not enough {network} numbers for {table.rows} rows")
            if c.refers and (c.fewest is not None or c.most is not None):
                parents = self.tables[c.refers[0]].rows
                if table.rows < parents * (c.fewest or 0) or (c.most is not None and table.rows > parents * c.most):
                    raise ValueError(f"{table.name}.{c.name}: {table.rows} rows do not fit {parents} parents")

    def source(self, table: str, column: str) -> Source:
        return Source(self.key, f"{table}.{column}", self.now)

    def parent_row(self, table: Table, c: Col, row: Column) -> Column:
        """Row number of the parent a child row points to."""
        parents = self.tables[c.refers[0]].rows
        label = c.group or c.name
        if c.refers[0] == table.name:
            draws = self.source(table.name, label).draws(row)
            earlier = (draws.raw(7) if table.rows <= 1 << 31 else draws.wide(7)) % F.greatest(row - 1, F.lit(1))
            return F.when(row > 1, earlier + 1)
        if c.fewest is not None or c.most is not None:
            return self.bounded_parent(table, c, row)
        return self.source(table.name, label).draws(row).below(7, parents) + 1

    def bounded_parent(self, table: Table, c: Col, row: Column) -> Column:
        """Parent of a row so that each parent has from ``fewest`` to ``most`` children.

        The first ``fewest`` rows of every parent come first. Each further row takes one of the places that are left under
        ``most``, numbered through and drawn without repetition by a keyed permutation, so counts vary as if drawn at random.
        """
        parents, fewest = self.tables[c.refers[0]].rows, c.fewest or 0
        source = self.source(table.name, c.group or c.name)
        rest = table.rows - parents * fewest
        room = (c.most if c.most is not None else fewest + max(1, rest)) - fewest
        turn = gen.permuted(source, (row - 1) % parents, parents, "parents")
        if rest <= 0 or room <= 0:
            return turn + 1
        if c.most is None:  # no upper bound: any parent
            free = source.draws(row).below(7, parents)
        else:
            place = gen.permuted(source, row - 1 - parents * fewest, parents * room, "places")
            free = F.floor(place / F.lit(room).cast("bigint")).cast("bigint")
        return F.when(row <= parents * fewest, turn).otherwise(free) + 1

    def pure(self, table: str, column: str) -> Col | None:
        """The column, when its value depends on nothing but its row number."""
        c = next(x for x in self.tables[table].columns if x.name == column)
        plain = not c.unique and c.check is None and c.refers is None and c.generator.upper() not in DERIVED
        return c if plain else None

    def at_parent(self, df: DataFrame, table: str, column: str, place: Column, name: str) -> DataFrame:
        """Adds the value of a parent column at a parent row."""
        c = self.pure(table, column)
        if c is not None:
            value = gen.generate(Spec(c.generator, c.p1, c.p2), self.source(table, column), place)
            return df.withColumn(name, F.when(place.isNotNull(), value))
        parents = self.done[table].select(F.col("_row").alias("_at"), F.col(column).cast("string").alias(name))
        return df.withColumn("_want", place).join(parents, F.col("_want") == F.col("_at"), "left").drop("_want", "_at")

    def table(self, name: str) -> DataFrame:
        plan = self.tables[name]
        row = F.col("_row")
        df = self.spark.range(1, plan.rows + 1).withColumnRenamed("id", "_row")
        refs = {c.name: c for c in plan.columns if c.refers}
        base = {
            c.name: gen.generate(Spec(c.generator, c.p1, c.p2), self.source(name, c.name), row)
            for c in plan.columns
            if not c.refers and c.generator.upper() not in DERIVED
        }
        df = df.select("_row", *[v.alias(n) for n, v in base.items()])
        for c in refs.values():
            df = self.at_parent(df, c.refers[0], c.refers[1], self.parent_row(plan, c, row), c.name)
        for _ in range(2):  # a derived column may use another one
            for c in plan.columns:
                if c.generator.upper() in DERIVED and c.name not in df.columns:
                    df = self.derived(df, plan, c, refs)
        for c in plan.columns:
            if c.unique:
                df = made_unique(df, c.name, c.type)
        checked = {c.name: enforced(F.col(c.name), c.check, row) for c in plan.columns if c.check}
        df = df.withColumns(checked) if checked else df
        out = df.select("_row", *[F.col(c.name).try_cast(c.type).alias(c.name) for c in plan.columns])
        if self.store:
            out.write.parquet(f"{self.store}/{name}")
            out = self.spark.read.parquet(f"{self.store}/{name}")
        self.done[name] = out
        return out

    def derived(self, df: DataFrame, plan: Table, c: Col, refs: Mapping[str, Col]) -> DataFrame:
        kind, row = c.generator.upper(), F.col("_row")
        have = {n.lower(): F.col(n) for n in df.columns}
        source = self.source(plan.name, c.name)
        if kind == "LOOKUP":
            ref = refs[c.p1]
            column, _, how = (c.p2 or "").partition(":")
            df = self.at_parent(df, ref.refers[0], column, self.parent_row(plan, ref, row), c.name)
            return df.withColumn(c.name, gen.modified(F.col(c.name), how))
        needed = {"COPY": [c.p1], "CASE": [c.p1], "DATE_AFTER": [c.p1]}.get(kind)
        if needed is None:
            tokens = re.findall(r"\$\{([^}:]*)", c.p1 or "")
            needed = [x.strip() for x in tokens if x.strip().lower() not in ("rand", "pick", "domain")]
        if any(n.lower() not in have for n in needed):
            return df
        if kind == "TEMPLATE":
            return df.withColumn(c.name, gen.template(c.p1, have, source, row))
        value = have[c.p1.lower()]
        if kind == "COPY":
            return df.withColumn(c.name, gen.modified(value, c.p2))
        if kind == "CASE":
            return df.withColumn(c.name, gen.case_map(value, c.p2 or ""))
        return df.withColumn(c.name, gen.date_after(value, c.p2, source, row))

    def run(self) -> dict[str, DataFrame]:
        edges = [Edge(t.name, c.name, *c.refers) for t in self.tables.values() for c in t.columns if c.refers]
        for name in referenced_first(list(self.tables), edges):
            self.table(name)
        return {n: df.drop("_row") for n, df in self.done.items()}


WHOLE_BITS = {"tinyint": 8, "byte": 8, "smallint": 16, "short": 16, "int": 32, "integer": 32, "bigint": 64, "long": 64}
FIRST_DAY, LAST_DAY = -719162, 2932896  # 0001-01-01 and 9999-12-31 as days since 1970


def value_range(kind: str) -> tuple[int, int, int] | None:
    """(least, greatest, decimal places) of a type's values as whole numbers; None where numbers may go on without end."""
    if kind.startswith(("date", "timestamp")):
        return FIRST_DAY, LAST_DAY, 0
    if kind in WHOLE_BITS:
        return -(2 ** (WHOLE_BITS[kind] - 1)), 2 ** (WHOLE_BITS[kind] - 1) - 1, 0
    found = re.fullmatch(r"(?:decimal|numeric)\((\d+)(?:,\s*(\d+))?\)", kind)
    if found and int(found[1]) <= 18:
        return 1 - 10 ** int(found[1]), 10 ** int(found[1]) - 1, int(found[2] or 0)
    return None


def free_numbers(taken: DataFrame, wanted: DataFrame, low: int, high: int, key: MaskKey | None = None) -> DataFrame:
    """``_row, _free`` for every ``_row`` of ``wanted``: a number of low .. high that is not in ``taken`` (``_n``, distinct), each once.

    The j-th free number is low + j + the number of taken ones t with t - low - (taken before t) <= j. Both sides are put in
    one order and numbered through, so a place says how many taken numbers stand before it; no gap is looked up by a join. With
    a ``key`` rows take the free numbers in the order of a keyed permutation.
    """
    from cloakwork.operators.positions import with_sequence

    rows = cut(with_sequence(wanted.select("_row"), ["_row"], "_j", 0))
    count, used = rows.count(), taken.count()
    if count > high - low + 1 - used:
        raise ValueError(f"{count} more unique values are wanted, {high - low + 1 - used} are free")
    if key is not None and count:
        # kept: the sort below asks for its keys twice, and a permutation takes a dozen digests
        rows = cut(rows.withColumn("_j", permuted(key, "gen|unique", F.col("_j").cast("bigint"), F.lit(count).cast("bigint"))))
    exact = "decimal(20,0)"
    placed = with_sequence(taken.select("_n"), ["_n"], "_i", 0)
    before = placed.select((F.col("_n").cast(exact) - F.lit(low).cast(exact) - F.col("_i")).cast(exact).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_row"))
    after = rows.select(F.col("_j").cast(exact).alias("_at"), F.lit(1).alias("_kind"), F.col("_row").cast("bigint").alias("_row"))
    merged = with_sequence(before.unionByName(after), ["_at", "_kind"], "_place", 0).where("_kind = 1")
    # of the entries before a free number, _at are free ones themselves, and the rest are taken
    return merged.select("_row", (F.col("_place").cast(exact) + F.lit(low).cast(exact)).cast("decimal(38,0)").alias("_free"))


def made_unique(df: DataFrame, column: str, kind: str = "string", key: MaskKey | None = None) -> DataFrame:
    """First row of each value keeps it; a later row gets a value of the column's type that no row has.

    Numbers and dates go on behind the largest value by the row number; where that would leave the type (or the year 9999) they
    take values that are free in its whole range, in the order of a keyed permutation if a ``key`` is given, and a range with
    too few of them raises ValueError. Text gets its row number behind a mark ("-", or "+" inside an e-mail); where that is some
    row's own value, the mark is made longer than any in the column. Nulls stay null. Values are counted before the shuffle and
    only the repeated ones are joined back, so a value that fills a third of the table costs one row on the small side.
    """
    own = F.col(column)
    repeated = df.where(own.isNotNull()).groupBy(own.alias("_value")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = df.join(repeated.drop("_n"), own == F.col("_value"), "left")
    later, number = F.col("_first").isNotNull() & (F.col("_row") != F.col("_first")), F.col("_row").cast("string")
    kind = kind.lower()
    if kind == "boolean":
        raise ValueError(f"{column}: a boolean column holds two values, it cannot be unique")
    dated = kind.startswith(("date", "timestamp"))
    limits = value_range(kind)
    if limits is not None:
        low, high, places = limits
        days = F.unix_date(own.try_cast("timestamp_ntz").cast("date")).cast("decimal(38,0)")
        units = days if dated else F.floor(own.try_cast("decimal(38,8)") * F.lit(10**places)).cast("decimal(38,0)")
        top, last = df.agg(F.max(units), F.max("_row")).first()
        if top is not None and int(top) + int(last) * 10**places > high:
            taken = df.select(units.alias("_n")).where(F.col("_n").between(low, high)).distinct()
            free = free_numbers(cut(taken), cut(joined.where(later).select("_row")), low, high, key)
            date = F.date_from_unix_date(F.col("_free").cast("int"))
            text = (date if kind == "date" else date.cast("timestamp_ntz")) if dated else (F.col("_free") / F.lit(10**places)).cast(f"decimal(20,{places})") if places else F.col("_free")
            out = joined.join(free.withColumnRenamed("_row", "_r"), F.col("_row") == F.col("_r"), "left")
            # kept: the next column's repair reads these rows six times
            return cut(out.withColumn(column, F.when(later, text.cast("string")).otherwise(own)).drop("_value", "_first", "_free", "_r"))
    if dated:
        top = df.agg(F.max(own.try_cast("timestamp_ntz")).alias("_top"))
        moved = F.timestamp_add("DAY", F.col("_row").cast("int"), F.col("_top")).cast("string" if kind != "date" else "date").cast("string")
        return joined.crossJoin(F.broadcast(top)).withColumn(column, F.when(later, moved).otherwise(own)).drop("_value", "_first", "_top")
    if not kind.startswith(("string", "varchar", "char")):
        top = df.agg(F.coalesce(F.max(own.try_cast("decimal(38,8)")), F.lit(0).cast("decimal(38,8)")).alias("_top"))
        whole = kind in WHOLE_BITS
        moved = (F.ceil("_top") if whole else F.col("_top")) + F.col("_row")
        return joined.crossJoin(F.broadcast(top)).withColumn(column, F.when(later, moved.cast("string")).otherwise(own)).drop("_value", "_first", "_top")
    spot = F.locate("@", own)
    suffixed = lambda dash, plus: F.when(
        spot > 1, F.concat(F.substr(own, F.lit(1), spot - 1), plus, number, F.substr(own, spot))
    ).otherwise(F.concat(own, dash, number))
    marks = df.agg(  # one row: the longest marks before a number
        F.coalesce(F.max(F.length(F.regexp_extract(own, r"(-*)[0-9]+$", 1))), F.lit(0)).alias("_dashes"),
        F.coalesce(F.max(F.length(F.regexp_extract(own, r"(\+*)[0-9]+@", 1))), F.lit(0)).alias("_pluses"),
    )
    tried = joined.withColumn("_tried", F.when(later, suffixed(F.lit("-"), F.lit("+"))))
    taken = df.select(own.alias("_taken")).where(F.col("_taken").isNotNull()).distinct()
    out = tried.join(taken, F.col("_tried") == F.col("_taken"), "left").crossJoin(F.broadcast(marks))
    longer = suffixed(F.repeat(F.lit("-"), F.col("_dashes") + 1), F.repeat(F.lit("+"), F.col("_pluses") + 1))
    value = F.when(~later, own).when(F.col("_taken").isNotNull(), longer).otherwise(F.col("_tried"))
    return out.withColumn(column, value).drop("_value", "_first", "_tried", "_taken", "_dashes", "_pluses")


def existing_keys(df: DataFrame, targets: DataFrame, key: str, column: str, generator_key: MaskKey, label: str) -> DataFrame:
    """Foreign key drawn from rows that already are in a target: its keys are numbered, each child draws a number."""
    from cloakwork.operators.positions import with_sequence

    numbered = with_sequence(targets.select(F.col(key).alias(column)).distinct(), [column], "_place", 0)
    size = numbered.count()
    draw = generator_key.index(f"gen|{label}", F.col("_row").cast("string"), size)
    return df.withColumn("_pick", draw).join(numbered, F.col("_pick") == F.col("_place")).drop("_pick", "_place")


def load_evidence(tables: Mapping[str, DataFrame], edges: Sequence[Edge], unique: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows, orphans per foreign key, repeated values per unique column, nulls per table."""
    parts = []
    for name, df in tables.items():
        nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
        parts.append(df.agg(F.count(F.lit(1)).alias("a"), nulls.alias("b")).select(
            F.explode(F.array(
                F.struct(F.lit("rows").alias("measure"), F.lit(name).alias("subject"), F.col("a").alias("amount")),
                F.struct(F.lit("nulls").alias("measure"), F.lit(name).alias("subject"), F.col("b").alias("amount")),
            )).alias("x")).select("x.*"))
        for column in unique.get(name, []):
            repeated = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            parts.append(repeated.agg(F.count(F.lit(1)).alias("amount")).select(F.lit("repeated").alias("measure"), F.lit(f"{name}.{column}").alias("subject"), "amount"))
    for e in edges:
        parents = tables[e.parent].select(F.col(e.parent_column).alias("_p")).distinct()
        lost = tables[e.child].where(F.col(e.child_column).isNotNull()).join(parents, F.col(e.child_column) == F.col("_p"), "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("amount")).select(F.lit("orphans").alias("measure"), F.lit(f"{e.child}.{e.child_column}").alias("subject"), "amount"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def look_alike(df: DataFrame, name: str, rows: int, keys: Sequence[str] = ()) -> Table:
    """Plan whose columns follow the profile of a real table (one profile row per column)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    advice = {r["column_name"]: r for r in recommend(df, keys).collect()}
    columns = [
        Col(c, advice[c]["generator"], advice[c]["param1"] or None, advice[c]["param2"] or None, kinds[c]) for c in df.columns
    ]
    return Table(name, rows, columns)


def with_rows(table: Table, rows: int) -> Table:
    return replace(table, rows=rows)
