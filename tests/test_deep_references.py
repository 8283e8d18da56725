"""Self references followed by pointer doubling, beside a plain walk."""

import random

import pytest

from cloakwork.operators import subset as sub
from cloakwork.operators.subset import Edge

SHAPES = {
    "chain": [(i, i - 1 if i else None) for i in range(70)],
    "tree": [(i, (i - 1) // 2 if i else None) for i in range(60)],
    "cycle": [(i, (i + 1) % 9) for i in range(9)] + [(i, i - 1 if i > 20 else 3) for i in range(20, 40)] + [(50, 50), (51, 50), (52, 99)],
    "forest": [(i, random.Random(i).choice([None, *range(max(0, i - 4), i)]) if i else None) for i in range(80)],
}


def walk(rows, start, up):
    parent = dict(rows)
    found, now, step = dict.fromkeys(start, 0), set(start), 0
    while now:
        step += 1
        now = {parent[x] for x in now if parent.get(x) in parent} if up else {x for x, p in rows if p in now}
        now = {x for x in now if x not in found}
        found.update(dict.fromkeys(now, step))
    return {x: s for x, s in found.items() if s}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("up", [False, True])
def test_all_below_and_above(spark, shape, up):
    rows = SHAPES[shape]
    frame = spark.createDataFrame(rows, "id int, boss int").repartition(2)
    for start in ([3, 33], [0], []):
        begun = spark.createDataFrame([(x,) for x in start], "id int")
        got = (sub.ancestors if up else sub.descendants)(frame, "id", "boss", begun).collect()
        assert {r["id"]: r["_steps"] for r in got} == walk(rows, start, up), (shape, start)


def test_closure_of_a_deep_chain_in_few_rounds(spark):
    rows = spark.createDataFrame(SHAPES["chain"], "id int, boss int")
    closure = sub.Closure({"c": rows}, {"c": ["id"]}, [Edge("c", "boss", "c", "id")], parents=False)
    found = closure.run({"c": spark.createDataFrame([(2,)], "id int")})
    assert closure.round <= sub.DEEP + 2 and found.counts["c"] == 68
    assert {r["id"]: r["found_in"] for r in found.keys["c"].collect()} == {i: i - 2 for i in range(2, 70)}
