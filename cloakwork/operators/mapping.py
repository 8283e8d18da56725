"""Row and column operators of a mapping: project, join, look up, route, pivot, union, rank, stage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.keyed import MaskKey
from cloakwork.functions.masks import Row, mask
from cloakwork.operators.positions import with_sequence
from cloakwork.session import small_side



def scan(source: DataFrame, where: str | None = None, rows: int | None = None) -> DataFrame:
    """Table scan with a pushed filter and an optional row limit."""
    out = source.where(where) if where and where.strip() else source
    return out.limit(rows) if rows else out


def sql_source(spark: SparkSession, text: str) -> DataFrame:
    """One read-only SELECT or WITH query."""
    statement = text.strip()
    if ";" in statement:
        raise ValueError("one statement only")
    if not re.match(r"(?i)(select|with)\b", statement):
        raise ValueError("only SELECT or WITH queries can be a source")
    return spark.sql(statement)


@dataclass(frozen=True)
class ColumnMap:
    """One target column: COPY, LITERAL, MASK or UNUSED."""

    target: str
    action: str = "COPY"
    source: str | None = None
    literal: object = None
    function: str | None = None
    salt: str | None = None
    p1: str | None = None
    p2: str | None = None


def select_as(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Select under temporary names, then rename: inside a lambda Spark may read a column name as the alias of an
    earlier column of the same select, so a result must not carry the name of an input while it is computed."""
    names = list(columns)
    return df.select(*[columns[n].alias(f"_out_{i}") for i, n in enumerate(names)]).toDF(*names)


def map_columns(df: DataFrame, maps: Sequence[ColumnMap], key: MaskKey | None = None) -> DataFrame:
    row = Row({c.lower(): F.col(c) for c in df.columns})
    out: dict[str, Column] = {}
    for m in maps:
        action = m.action.upper()
        if action == "UNUSED":
            continue
        if action == "LITERAL":
            out[m.target] = F.lit(m.literal)
        elif action == "MASK":
            if key is None:
                raise ValueError("MASK columns need a key")
            out[m.target] = mask(m.function, F.col(m.source), key, m.salt, m.p1, m.p2, row)
        else:
            out[m.target] = F.col(m.source or m.target)
    return select_as(df, out)


def join_on(left: DataFrame, right: DataFrame, links: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on all links between two sources (``alias.column`` names), ANDed into one key."""
    return left.join(right, [F.expr(a) == F.expr(b) for a, b in links], how)


def join_as_text(left: DataFrame, right: DataFrame, links: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join of sources from different systems: keys compared as trimmed text, no row cap."""
    text = [F.trim(F.expr(a).cast("string")) == F.trim(F.expr(b).cast("string")) for a, b in links]
    return left.join(right, text, how)


def join_unlinked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Source without a link: every row meets every row, as the plan's author asked; Spark picks the side to broadcast."""
    return left.crossJoin(right)


def look_up(df: DataFrame, reference: DataFrame, on: Column | str, returns: Sequence[str] | None = None) -> DataFrame:
    """Left join of a reference table; broadcast only when its size was checked."""
    condition = F.expr(on) if isinstance(on, str) else on
    joined = df.join(small_side(reference), condition, "left")
    if returns is None:
        return joined
    return joined.select(*[df[c] for c in df.columns], *[F.expr(r) for r in returns])


def aggregate(df: DataFrame, group: Sequence[str], aggregates: Mapping[str, str]) -> DataFrame:
    return df.groupBy(*[F.expr(g) for g in group]).agg(*[F.expr(e).alias(n) for n, e in aggregates.items()])


def pivot(df: DataFrame, group: Sequence[str], category: str, value: str, values: Sequence[str], how: str = "sum") -> DataFrame:
    """One column per listed category value."""
    return df.groupBy(*group).pivot(category, list(values)).agg(F.expr(f"{how}({value})"))


def union(df: DataFrame, other: DataFrame, every: bool = True) -> DataFrame:
    """Append by position; ``every=False`` removes duplicates."""
    both = df.union(other)
    return both if every else both.distinct()


def string_aggregate(df: DataFrame, group: Sequence[str], value: str, name: str, gap: str = ",") -> DataFrame:
    """Distinct values of a group as ordered text. Values are made distinct before they meet in one place."""
    return df.select(*group, value).distinct().groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), gap).alias(name)
    )


def route(df: DataFrame, conditions: Mapping[str, str | None]) -> DataFrame:
    """Rows with the route they take, in one pass; a row may take several. No condition = none of the others."""
    explicit = [F.expr(c) for c in conditions.values() if c]
    nothing = F.lit(True)
    for c in explicit:
        nothing = nothing & ~F.coalesce(c, F.lit(False))
    marks = [F.when(F.expr(c) if c else nothing, F.lit(n)) for n, c in conditions.items()]
    return df.withColumn("route", F.explode(F.array_compact(F.array(*marks))))


def stage(df: DataFrame, columns: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """Staging projection ``(name, source, type)``: rename, retype, null for an unlinked column."""
    out = []
    for name, source, kind in columns:
        col = F.col(source) if source else F.lit(None).cast(kind or "string")
        out.append((col.cast(kind) if kind and source else col).alias(name))
    return df.select(*out)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Semi-join on a key set."""
    return df.join(keys.select(*on), list(on), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not kept."""
    return df.join(keys.select(*on), list(on), "left_anti")


def preview(df: DataFrame, rows: int = 100) -> tuple[DataFrame, bool]:
    """First rows and whether more exist."""
    return df.limit(rows), df.limit(rows + 1).count() > rows


def page(df: DataFrame, key: Sequence[str], rows: int, skip: int = 0) -> tuple[DataFrame, bool]:
    """Page of the size asked for, in key order, and whether another page follows."""
    if rows < 1:
        raise ValueError("a page holds at least one row")
    ordered = df.orderBy(*key).offset(skip)
    return ordered.limit(rows), ordered.limit(rows + 1).count() > rows


def sequence(df: DataFrame, order: Sequence[str], name: str = "seq_no") -> DataFrame:
    return with_sequence(df, order, name)
