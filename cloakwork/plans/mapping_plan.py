"""A mapping described as data and run as DataFrame calls.

Order of evaluation (it is observable): joins, look-ups, filters, pivot or aggregate or expressions, sequence,
distinct, union, rank, sort, limit, staging.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators import mapping as ops
from cloakwork.operators.positions import group_positions, top_in_group


@dataclass
class Source:
    alias: str
    frame: DataFrame
    where: str | None = None


@dataclass
class Link:
    left: str
    right: str
    how: str = "inner"


@dataclass
class MappingPlan:
    sources: Sequence[Source]
    links: Sequence[Link] = ()
    lookups: Sequence[tuple[Source, str, Sequence[str]]] = ()
    filters: Sequence[str] = ()
    routes: Mapping[str, str | None] = field(default_factory=dict)
    active_route: str | None = None
    pivot: Mapping[str, object] | None = None
    aggregates: tuple[Sequence[str], Mapping[str, str]] | None = None
    expressions: Mapping[str, str] | None = None
    sequence: tuple[str, Sequence[str]] | None = None
    distinct: bool = False
    unions: Sequence[tuple[DataFrame, bool]] = ()
    rank: Mapping[str, object] | None = None
    sort: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    staging: Sequence[Sequence[tuple[str, str | None, str | None]]] = ()


def joined(plan: MappingPlan) -> DataFrame:
    """Sources joined along their links, first reachable link first; several links make one composite key."""
    frames = {s.alias: s.frame.alias(s.alias) for s in plan.sources}
    first = plan.sources[0].alias
    out, seen, links = frames[first], {first}, list(plan.links)
    while links:
        ends = [(link, link.left.split(".")[0], link.right.split(".")[0]) for link in links]
        start = next(((n, a, b) for n, a, b in ends if (a in seen) != (b in seen)), None)
        if start is None:
            break
        new = start[2] if start[1] in seen else start[1]
        group = [(n, a, b) for n, a, b in ends if {a, b} - seen == {new}]
        keys = [(n.left, n.right) if a in seen else (n.right, n.left) for n, a, b in group]
        out = ops.join_on(out, frames[new], keys, start[0].how)
        seen.add(new)
        links = [n for n in links if n not in [g[0] for g in group]]
    for s in plan.sources:
        if s.alias not in seen:
            out = ops.join_unlinked(out, frames[s.alias])
    return out


def run(plan: MappingPlan) -> DataFrame:
    df = joined(plan)
    extra: list[str] = []
    for source, on, returns in plan.lookups:
        df = df.join(ops.small_side(source.frame).alias(source.alias), F.expr(on), "left")
        extra.extend(returns)
    for condition in [*plan.filters, *[s.where for s in plan.sources if s.where]]:
        df = df.where(condition)
    if plan.active_route and plan.routes.get(plan.active_route):
        df = df.where(plan.routes[plan.active_route])
    if plan.pivot:
        df = ops.pivot(df, **plan.pivot)
    elif plan.aggregates:
        df = ops.aggregate(df, *plan.aggregates)
    elif plan.expressions:
        df = df.select(*[F.expr(e).alias(n) for n, e in plan.expressions.items()], *[F.expr(r) for r in extra])
    if plan.sequence:
        df = ops.sequence(df, plan.sequence[1], plan.sequence[0])
    if plan.distinct:
        df = df.distinct()
    for other, every in plan.unions:
        df = ops.union(df, other, every)
    if plan.rank:
        group, order = list(plan.rank.get("group", [])), [F.expr(o) if isinstance(o, str) else o for o in plan.rank["order"]]
        name, top = plan.rank.get("name", "rank_in_group"), plan.rank.get("top")
        if top:
            df = top_in_group(df, group, order, int(top), name)
        else:
            df = group_positions(df, group, order, name).drop("group_rows")
    if plan.sort:
        df = df.orderBy(*[F.col(c).desc() if d.upper() == "DESC" else F.col(c).asc() for c, d in plan.sort])
    if plan.limit:
        df = df.limit(plan.limit)
    for columns in plan.staging:
        df = ops.stage(df, columns)
    return df
