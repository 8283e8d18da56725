"""Referential subsetting: seed keys, follow foreign keys to a fixed point, extract the rows.

A selection is one frame of keys per table, never a driver-side set. Each round follows only the keys that were new
in the round before, keeps what an anti-join against the selection lets through, and writes it to reliable storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.session import cut


@dataclass(frozen=True)
class Edge:
    """Foreign key from a child column to a parent column."""

    child: str
    child_column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Directive:
    """Per-table rules: EXCLUDED, INDEPENDENT (own seed, not pulled as a child), FOLLOW; parents/children YES, NO, DEFER."""

    mode: str = "FOLLOW"
    where: str | None = None
    limit: int | None = None
    parents: str | None = None
    children: str | None = None


@dataclass
class Selection:
    """Selected keys per table with the round in which each key was found."""

    keys: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    keyless: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)


def seed(df: DataFrame, key: Sequence[str], where: str | None = None, limit: int | None = None) -> DataFrame:
    """Keys of the driver rows; with a limit the first ones in key order."""
    rows = df.where(where) if where and where.strip() else df
    keys = rows.select(*key)
    return keys.orderBy(*key).limit(limit) if limit else keys


def children_of(child: DataFrame, child_column: str, child_key: Sequence[str], parents: DataFrame, parent_column: str) -> DataFrame:
    """Keys of the child rows whose foreign key is among the parent values."""
    values = parents.select(F.col(parent_column).alias(child_column))
    return child.join(values, child_column, "left_semi").select(*child_key).distinct()


def parents_of(
    child: DataFrame, child_key: Sequence[str], child_keys: DataFrame, child_column: str, parent: DataFrame,
    parent_key: Sequence[str], parent_column: str,
) -> DataFrame:
    """Keys of the parent rows that selected children point to; the target may be a non-key column."""
    wanted = child.join(child_keys, list(child_key), "left_semi").select(F.col(child_column).alias(parent_column))
    wanted = wanted.where(F.col(parent_column).isNotNull()).distinct()
    return parent.join(wanted, parent_column, "left_semi").select(*parent_key).distinct()


def _doubled(pairs: DataFrame, of: Column) -> DataFrame:
    """Pointers (``id, ptr``) of each row's pointer."""
    return pairs.select(F.col("id").alias("_i"), F.col("ptr").alias("_p")).join(pairs.select(F.col("id").alias("_p"), of.alias("ptr")), "_p").select(
        F.col("_i").alias("id"), "ptr"
    )


def descendants(rows: DataFrame, key: str, reference: str, start: DataFrame) -> DataFrame:
    """``key, _steps``: all rows below the start along a self reference, at their distance, by pointer doubling.

    Each round every row that has no start above it yet looks twice as far up, so a chain of n rows takes log n joins of the
    table with itself, not n rounds. Rows in cycles without a start end with the number of rows.
    """
    begun = start.select(F.col(key).alias("id"), F.lit(0).cast("bigint").alias("steps")).distinct()
    own = rows.select(F.col(key).alias("id"), F.col(reference).alias("ptr"))
    state = cut(own.join(begun, "id", "left").select("id", F.when(F.col("steps").isNull(), F.col("ptr")).alias("ptr"), "steps"))
    count, far = state.count(), 1
    while far <= count and not state.where("ptr IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("_p"), F.col("ptr").alias("_next"), F.col("steps").alias("_more"))
        steps = F.coalesce("steps", F.col("_more") + far)
        state = cut(
            state.join(above, F.col("ptr") == F.col("_p"), "left").select("id", F.when(steps.isNull(), F.col("_next")).alias("ptr"), steps.alias("steps"))
        )
        far *= 2
    return state.where("steps > 0").select(F.col("id").alias(key), F.col("steps").alias("_steps"))


def ancestors(rows: DataFrame, key: str, reference: str, start: DataFrame) -> DataFrame:
    """``key, _steps``: all rows above the start along a self reference, at their distance, by pointer doubling."""
    present = rows.select(F.col(key).alias("id")).distinct()
    pointers = rows.select(F.col(key).alias("id"), F.col(reference).alias("ptr")).where("ptr IS NOT NULL AND ptr <> id")
    pointers = cut(pointers.join(present.select(F.col("id").alias("ptr")), "ptr", "left_semi").select("id", "ptr"))
    reached = cut(start.select(F.col(key).alias("id"), F.lit(0).cast("bigint").alias("steps")).distinct())
    count, far = pointers.count(), 1
    while far <= count and not pointers.isEmpty():
        higher = reached.join(pointers, "id").select(F.col("ptr").alias("id"), (F.col("steps") + far).alias("steps"))
        reached = cut(reached.unionByName(higher).groupBy("id").agg(F.min("steps").alias("steps")))
        pointers, far = cut(_doubled(pointers, F.col("ptr"))), far * 2
    return reached.where("steps > 0").select(F.col("id").alias(key), F.col("steps").alias("_steps"))


DEEP = 4  # rounds after which a self reference is followed to its end by pointer doubling


class Closure:
    """Follows foreign keys from the seeds until a round adds nothing.

    A self reference onto the table's key that still finds rows after DEEP rounds is followed to its end in one round, by
    pointer doubling; its rows count as found as many rounds later as they are steps away.
    """

    def __init__(
        self, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], edges: Sequence[Edge],
        parents: bool = True, children: bool = True, directives: Mapping[str, Directive] | None = None,
        only_listed: bool = False,
    ):
        self.tables, self.keys, self.edges = tables, keys, edges
        self.parents, self.children = parents, children
        self.directives = dict(directives or {})
        self.only_listed = only_listed
        self.found: dict[str, list[DataFrame]] = {}
        self.total: dict[str, int] = {}
        self.round = 0
        self.selection = Selection()

    def _merge(self, table: str, candidates: Sequence[DataFrame]) -> DataFrame | None:
        """Keep the keys not selected before; None when there are none."""
        key = list(self.keys[table])
        steps = [c if "_steps" in c.columns else c.withColumn("_steps", F.lit(0).cast("bigint")) for c in candidates]
        rows = reduce(DataFrame.unionByName, steps).groupBy(*key).agg(F.min("_steps").alias("_steps"))
        if self.found.get(table):
            known = reduce(DataFrame.unionByName, self.found[table])
            rows = rows.join(known.select(*key), key, "left_anti")
        found_in = F.greatest(F.col("_steps").cast("int") - 1, F.lit(0)) + self.round
        new = cut(rows.select(*key, found_in.alias("found_in")))
        count = new.count()
        if count == 0:
            return None
        self.found.setdefault(table, []).append(new)
        self.total[table] = self.total.get(table, 0) + count
        if len(self.found[table]) > 6:
            self.found[table] = [cut(reduce(DataFrame.unionByName, self.found[table]))]
        return new

    def _open(self, table: str) -> bool:
        rule = self.directives.get(table)
        if rule is None:
            return not self.only_listed
        return rule.mode.upper() != "EXCLUDED"

    def _follow(self, table: str, side: str, deferred: bool) -> bool:
        rule = self.directives.get(table)
        choice = getattr(rule, side) if rule else None
        if choice is None:
            return getattr(self, side)
        choice = choice.upper()
        return choice == "YES" or (choice == "DEFER" and deferred)

    def _step(self, fresh: Mapping[str, DataFrame], deferred: bool) -> dict[str, DataFrame]:
        candidates: dict[str, list[DataFrame]] = {}
        for e in self.edges:
            if e.parent == e.child and self.round > DEEP and e.child in fresh and list(self.keys.get(e.child, ())) == [e.parent_column]:
                self._follow_deep(e, fresh[e.child], deferred, candidates)
                continue
            if e.parent in fresh and self._follow(e.parent, "children", deferred) and self._open(e.child):
                independent = self.directives.get(e.child, Directive()).mode.upper() == "INDEPENDENT"
                if e.child not in self.keys:
                    self.selection.warn(f"{e.child} has no key and is not followed")
                elif not independent:
                    values = fresh[e.parent]
                    if list(self.keys[e.parent]) != [e.parent_column]:
                        values = self.tables[e.parent].join(values, list(self.keys[e.parent]), "left_semi")
                    candidates.setdefault(e.child, []).append(
                        children_of(self.tables[e.child], e.child_column, self.keys[e.child], values, e.parent_column)
                    )
            if e.child in fresh and self._follow(e.child, "parents", deferred) and self._open(e.parent):
                if e.parent not in self.keys:
                    self.selection.warn(f"{e.parent} has no key and is not followed")
                else:
                    candidates.setdefault(e.parent, []).append(
                        parents_of(
                            self.tables[e.child], self.keys[e.child], fresh[e.child], e.child_column,
                            self.tables[e.parent], self.keys[e.parent], e.parent_column,
                        )
                    )
        added = {}
        for table, frames in candidates.items():
            new = self._merge(table, frames)
            if new is not None:
                added[table] = new
        return added

    def _follow_deep(self, e: Edge, fresh: DataFrame, deferred: bool, candidates: dict[str, list[DataFrame]]) -> None:
        """All rows below and above the fresh ones along a self reference."""
        rows, independent = self.tables[e.child], self.directives.get(e.child, Directive()).mode.upper() == "INDEPENDENT"
        if not self._open(e.child):
            return
        if self._follow(e.parent, "children", deferred) and not independent:
            candidates.setdefault(e.child, []).append(descendants(rows, e.parent_column, e.child_column, fresh))
        if self._follow(e.child, "parents", deferred):
            candidates.setdefault(e.child, []).append(ancestors(rows, e.parent_column, e.child_column, fresh))

    def run(self, seeds: Mapping[str, DataFrame]) -> Selection:
        fresh: dict[str, DataFrame] = {}
        for table, rows in seeds.items():
            new = self._merge(table, [rows])
            if new is not None:
                fresh[table] = new
        later = any("DEFER" in ((d.parents or "").upper(), (d.children or "").upper()) for d in self.directives.values())
        for deferred in (False, True) if later else (False,):
            if deferred:
                fresh = {t: reduce(DataFrame.unionByName, parts) for t, parts in self.found.items()}
            while fresh:  # ends, as each round adds keys of finite tables
                self.round += 1
                fresh = self._step(fresh, deferred)
        return self._finish()

    def _finish(self) -> Selection:
        lost: dict[str, DataFrame] = {}
        for table, parts in self.found.items():
            keys, rule = reduce(DataFrame.unionByName, parts), self.directives.get(table)
            count = self.total[table]
            if rule and rule.mode.upper() == "EXCLUDED":
                continue
            if rule and rule.mode.upper() != "INDEPENDENT" and rule.where:
                own = list(self.keys[table])
                keys = cut(keys.join(self.tables[table].where(rule.where).select(*own), own, "left_semi"))
                count = keys.count()
            if rule and rule.limit and count > rule.limit:
                kept = cut(cap(keys, self.keys[table], rule.limit))
                lost[table] = keys.join(kept, list(self.keys[table]), "left_anti").select(*self.keys[table])
                keys, count = kept, rule.limit
            self.selection.keys[table], self.selection.counts[table] = keys, count
        self._drop_orphans(lost)
        return self.selection

    def _drop_orphans(self, lost: dict[str, DataFrame]) -> None:
        """A cap must not leave rows that point at what it cut off: these go too, and what points at them."""
        chosen = self.selection
        while lost:
            gone: dict[str, list[DataFrame]] = {}
            for e in self.edges:
                if e.parent in lost and e.child in chosen.keys:
                    values = lost[e.parent]
                    if list(self.keys[e.parent]) != [e.parent_column]:
                        values = self.tables[e.parent].join(values, list(self.keys[e.parent]), "left_semi")
                    own = list(self.keys[e.child])
                    children = children_of(self.tables[e.child], e.child_column, own, values, e.parent_column)
                    gone.setdefault(e.child, []).append(children.join(chosen.keys[e.child].select(*own), own, "left_semi"))
            lost = {}
            for table, parts in gone.items():
                own = list(self.keys[table])
                dropped = cut(reduce(DataFrame.unionByName, parts).distinct())
                count = dropped.count()
                if count:
                    lost[table] = dropped
                    chosen.keys[table] = cut(chosen.keys[table].join(dropped, own, "left_anti"))
                    chosen.counts[table] -= count


def cap(keys: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """First keys in order of discovery (round, then key)."""
    return keys.orderBy("found_in", *key).limit(rows)


def plan_subset(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], edges: Sequence[Edge], driver: str,
    where: str | None = None, limit: int | None = None, parents: bool = True, children: bool = True,
    extra: Mapping[str, tuple[str | None, int | None]] | None = None,
    directives: Mapping[str, Directive] | None = None, only_listed: bool = False,
) -> Selection:
    """Selected keys of a driver table and everything its foreign keys reach in the chosen directions."""
    if driver not in keys:
        selection = Selection()
        rows = tables[driver].where(where) if where else tables[driver]
        selection.keyless[driver] = rows.limit(limit) if limit else rows
        selection.counts[driver] = selection.keyless[driver].count()
        selection.warn(f"{driver} has no key: planned a slice of it alone")
        return selection
    seeds = {driver: seed(tables[driver], keys[driver], where, limit)}
    own = {t: (d.where, d.limit) for t, d in (directives or {}).items() if d.mode.upper() == "INDEPENDENT"}
    for table, (condition, rows) in {**(extra or {}), **own}.items():
        if table != driver and table in keys:
            seeds[table] = seed(tables[table], keys[table], condition, rows)
    return Closure(tables, keys, edges, parents, children, directives, only_listed).run(seeds)


def extract(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], selection: Selection) -> dict[str, DataFrame]:
    """Rows of the selected keys, one frame per table."""
    out = dict(selection.keyless)
    for table, found in selection.keys.items():
        out[table] = tables[table].join(found.select(*keys[table]), list(keys[table]), "left_semi")
    return out


def row_counts(selection: Selection, spark) -> DataFrame:
    """Rows per table and their total (plan evidence; one row per table)."""
    rows = sorted(selection.counts.items())
    rows.append(("TOTAL", sum(selection.counts.values())))
    return spark.createDataFrame(rows, "table_name string, selected_rows bigint")


def referenced_first(tables: Sequence[str], edges: Sequence[Edge]) -> list[str]:
    """Tables in load order: parents before children, cycles last in name order."""
    left, out = set(tables), []
    while left:
        ready = sorted(
            t for t in left if not any(e.child == t and e.parent in left and e.parent != t for e in edges)
        ) or sorted(left)[:1]
        out.extend(ready)
        left -= set(ready)
    return out
