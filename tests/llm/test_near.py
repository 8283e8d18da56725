import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from texts import HARD

from cloakwork.llm import embedding_dedup, jaccard_join
from cloakwork.llm.components import connected_components
from cloakwork.llm.graph_index import SmallWorld

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups(dict):
    def of(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self[b] = a


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(i, (i * 7 + 3) % 90) for i in range(90)], [(5, 5)], [],
    [(i, i + 1) for i in range(0, 40, 2)] + [(1, 39)], [(None, 1), (2, 3), (3, 2), (2, 3)],
])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = Groups()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            groups.join(a, b)
    assert got == {x: groups.of(x) for x in list(groups)}


def shingles(text, size=4):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def by_hand(rows, percent):
    sets = [shingles(t) for _, t in rows]
    groups = Groups()
    for a in range(len(rows)):
        groups.of(a)
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * either:
                groups.join(a, b)
    least = defaultdict(list)
    for a in range(len(rows)):
        least[groups.of(a)].append(rows[a][0])
    named = {g: min((i for i in ids if i is not None), default=None) for g, ids in least.items()}
    return sorted((str(i), len(sets[a]), str(named[groups.of(a)])) for a, (i, _) in enumerate(rows))


def near_copies(draw, text, changes):
    words = text.split()
    for _ in range(changes):
        at = draw.randrange(len(words))
        words[at] = "new%d" % draw.randrange(10**6)
    return " ".join(words)


def test_joins_as_by_brute_force(spark, documents):
    draw = random.Random(11)
    fresh = lambda n: " ".join("w%d" % draw.randrange(5000) for _ in range(n))
    texts = list(HARD)
    for size in (1, 2, 3, 4, 5, 7, 12, 30, 90, 300):
        for _ in range(4):
            base = fresh(size)
            texts += [base, base, base.upper().lower(), base + " tail", near_copies(draw, base, max(1, size // 40)), near_copies(draw, base, max(1, size // 25))]
    passage = fresh(60)
    texts += [fresh(8) + " " + passage + " " + fresh(8) for _ in range(25)]  # a passage that many share
    chain = fresh(120)
    for _ in range(12):  # each close to the one before, the ends far apart
        chain = near_copies(draw, chain, 1)
        texts.append(chain)
    rows = [*enumerate(texts), (None, "only here and nowhere else"), (None, texts[-1]), (7, fresh(20)), (7, texts[40])]
    for percent in (85, 60, 100):
        got = jaccard_join.link(documents(rows), percent=percent).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == by_hand(rows, percent)


def test_join_of_nothing(spark, documents):
    assert jaccard_join.link(documents([])).count() == 0
    got = jaccard_join.link(documents([(1, None), (2, ""), (None, " ")])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == [("1", 0, "1"), ("2", 0, "2"), ("None", 0, "None")]
    with pytest.raises(ValueError):
        jaccard_join.link(documents([]), percent=0)


@pytest.mark.parametrize("task_bytes", [1 << 20, 4000])  # whole buckets, and buckets in blocks
def test_cross_links_join_all_similar_pairs_and_stay_few(spark, task_bytes):
    draw = np.random.default_rng(4)
    base, given = np.unique(draw.integers(0, 2**63, 120)).astype(np.uint64), []
    for i in range(40):  # four families: alike inside, mostly below the threshold between them, chains in between
        held = np.delete(base, draw.choice(len(base), 3 + 6 * (i % 4), replace=False))
        given.append(np.unique(np.concatenate([held, draw.integers(0, 2**63, 3).astype(np.uint64)])))
    keys = [i.to_bytes(16, "big") for i in range(len(given))]
    root = {k: keys[0] if i < 5 else k for i, k in enumerate(keys)}
    buckets = {1: keys[:30], 2: keys[20:], 3: keys[38:], 4: keys[:5]}
    rows = [(b, k, root[k], len(given[i])) for b, ks in buckets.items() for i, k in enumerate(keys) if k in ks]
    members = spark.createDataFrame(rows, "bucket long, key binary, root binary, n long")
    sets = spark.createDataFrame([(k, s.tobytes()) for k, s in zip(keys, given)], "key binary, shingles binary")
    got = [(bytes(r["a"]), bytes(r["b"])) for r in jaccard_join.cross_links(members, sets, 85, task_bytes).collect()]
    similar = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    wanted = {(a, b) for ks in buckets.values() for a in ks for b in ks if a < b and similar(given[keys.index(a)], given[keys.index(b)])}

    def trees(pairs):
        groups = Groups()
        for k in keys:
            groups.join(k, root[k])
        for a, b in pairs:
            groups.join(a, b)
        return {frozenset(k for k in keys if groups.of(k) == groups.of(o)) for o in keys}

    assert trees(got) == trees(wanted) and len(trees(wanted)) > 1
    assert task_bytes < 1 << 20 or len(got) <= 2 * len(keys)
    assert jaccard_join.cross_links(members.limit(0), sets, 85).count() == 0


def test_parities_never_tell_similar_sets_apart():
    draw = np.random.default_rng(8)
    fresh = lambda n: np.unique(draw.integers(0, 2**63, n)).astype(np.uint64)
    sets = [fresh(n) for n in (1, 2, 5, 63, 64, 65, 66, 120, 129, 700)]
    sets += [np.unique(np.concatenate([s[len(s) // 9 :], fresh(len(s) // 7)])) for s in sets] + [np.concatenate([s, s[:1] + np.uint64(1)]) for s in sets]
    packed = jaccard_join.ParitySketches([jaccard_join.parities(s) for s in sets])
    x, y = (i.reshape(-1) for i in np.indices((len(sets), len(sets))))
    apart = packed.apart(x, y)
    assert (apart <= [len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)]).all() and (apart[x == y] == 0).all()
    assert apart[(x == 9) & (y == 8)] > 0 and max(packed.width) * 8 * 32 <= max(map(len, sets)) * 8 * 2
    size = np.array([len(s) for s in sets])
    similar = np.array([[100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)) for t in sets] for s in sets])
    for leaf, alike in ((64, 0), (2, 0), (2, 20)):  # pairs of small blocks, large blocks, and one root that most rows have
        jaccard_join.LEAF, before = leaf, jaccard_join.LEAF
        root = np.maximum(np.arange(len(sets)) - alike, 0)
        part, whole = np.zeros(len(sets), np.int64), np.ones(len(sets), bool)
        try:
            hit = jaccard_join.with_a_partner(part, np.arange(len(sets)), root, part, whole, size, packed, 80)
        finally:
            jaccard_join.LEAF = before
        assert (hit >= (similar & (root[:, None] != root)).any(axis=1)).all()


@pytest.mark.parametrize("task_bytes", [1 << 20, 1000])
def test_sets_that_only_share_frequent_shingles_leave_their_buckets(spark, task_bytes):
    """Their whole sets were sent to every task that such a bucket went to."""
    draw = np.random.default_rng(5)
    common = draw.integers(0, 2**63, 2)
    given = [np.unique(np.append(common, draw.integers(0, 2**63, 200))).astype(np.uint64) for _ in range(90)]
    given.append(np.unique(np.append(given[7][3:], np.uint64(12345))))
    keys = [i.to_bytes(16, "big") for i in range(len(given))]
    rows = [(b, k, k, len(s)) for b in range(3) for k, s in zip(keys, given)]
    members = spark.createDataFrame(rows, "bucket long, key binary, root binary, n long")
    sketches = [(k, len(s), jaccard_join.parities(s)) for k, s in zip(keys, given)]
    sketches = spark.createDataFrame(sketches, "key binary, n long, sketch binary")
    got = sorted((r["bucket"], bytes(r["key"]), r["n"]) for r in jaccard_join.likely_members(members, sketches, 85, task_bytes).collect())
    assert got == [(b, keys[i], len(given[i])) for b in range(3) for i in (7, 90)]


def test_alike_in_steps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 7)
    one = np.arange(20, dtype=np.uint64)
    others = [np.arange(n, m, dtype=np.uint64) for n, m in ((0, 20), (3, 20), (4, 20), (19, 25), (50, 90), (0, 23), (0, 24))]
    assert jaccard_join.alike(one, others, 85).tolist() == [True, True, False, False, False, True, False]


def test_every_similar_pair_shares_a_signature():
    draw = np.random.default_rng(2)
    for percent in (85, 70):
        for size in (1, 2, 3, 5, 6, 7, 13, 20, 33, 57, 100, 400):
            sets = []
            for _ in range(30):  # pairs as far apart as the threshold allows
                universe = draw.integers(0, 2**63, 2 * size + 2, dtype=np.int64).astype(np.uint64)
                most = size * (100 - percent) // 100
                a = universe[:size]
                b = np.concatenate([a[most:], universe[size : size + draw.integers(0, most + 1)]])
                sets += [np.unique(a), np.unique(b)]
            bands = jaccard_join.SizeBands(percent, max(map(len, sets)))
            number, value = jaccard_join.signatures(sets, bands)
            own = [set(value[number == i].tolist()) for i in range(len(sets))]
            for i in range(0, len(sets), 2):
                both, either = len(np.intersect1d(sets[i], sets[i + 1])), len(np.union1d(sets[i], sets[i + 1]))
                if 100 * both >= percent * either and both < either:  # equal sets are one class from the start
                    assert own[i] & own[i + 1], (percent, size, both, either)


def test_shingles_of_short_texts():
    sets = jaccard_join.shingle_sets(pa.array(["A b", "a  B", "b a", "a b c", None, " "]), 4)
    assert sets[0].tolist() == sets[1].tolist() != sets[2].tolist()
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 0]


def vectors(draw, groups=(40, 25, 3), singles=300, dim=16):
    out = []
    for size in groups:
        centre = draw.normal(size=dim)
        out += [centre + 0.05 * draw.normal(size=dim) for _ in range(size)]
    return out + [draw.normal(size=dim) for _ in range(singles)]


def test_embeddings_as_by_brute_force(spark):
    draw = np.random.default_rng(3)
    given = [v.astype(np.float32).tolist() for v in vectors(draw)]
    given += [given[0]] * 50 + [(2 * np.array(given[1])).tolist()] + [given[-1]] * 2  # copies, a scaled copy
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(given + odd)] + [(None, given[0], 1, "x"), (None, None, 1, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class int, root string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embedding_dedup.link_embeddings(frame).collect())
    valid = [i for i, (_, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    groups, links = Groups(), [0] * len(rows)
    for i in range(len(rows)):
        groups.of(i)
    for a in valid:
        for b in valid:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                    groups.join(a, b)
                    links[a] += 1
                    links[b] += 1
    named = {}
    for i, row in enumerate(rows):
        g = groups.of(i)
        named[g] = row[0] if named.get(g) is None else min(named[g], row[0] if row[0] is not None else named[g])
    want = sorted((str(r[0]), links[i], str(named[groups.of(i)]), r[0] is not None and r[0] == named[groups.of(i)]) for i, r in enumerate(rows))
    assert got == want
    assert embedding_dedup.link_embeddings(frame.limit(0)).count() == 0


def test_graph_recall():
    draw = np.random.default_rng(9)
    v = np.array(vectors(draw, (300, 120), 2000, 24), np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = SmallWorld(v)
    q, r = graph.within(v, 0.9, 32)
    found = set(zip(q.tolist(), graph.order[r].tolist()))
    a, b = np.nonzero(v @ v.T >= 0.9)
    assert sum((x, y) in found for x, y in zip(a.tolist(), b.tolist())) >= 0.99 * len(a)
    for size in (1, 2, 3):
        small = SmallWorld(v[:size])
        assert len(small.within(v[:size], 0.999, 4)[0]) >= size


@pytest.mark.parametrize("hot, pairs", [(400, 40), (0, 300)])
def test_audit_sees_lost_links_of_small_groups(hot, pairs):
    """Half of each pair cannot be reached in the graph: neither a hot group nor sparse links may hide that."""
    draw = np.random.default_rng(6)
    centre, twins = draw.normal(size=32), draw.normal(size=(pairs, 32))
    given = np.concatenate([centre + 0.02 * draw.normal(size=(hot, 32)), twins, twins + 0.01 * draw.normal(size=(pairs, 32))])
    n = len(given)
    columns = {"dim": [32] * n, "shard": [0] * n, "class": list(range(n)), "copies": [1] * n, "embedding": given.tolist()}
    shard = embedding_dedup._build(pa.table(columns))
    at = np.frombuffer(shard.column("classes")[0].as_py(), "<i8")
    lost = np.flatnonzero(at >= hot + pairs)
    lost, near = lost[lost > 0], []  # row 0 is the entry
    for raw, width in zip(shard.column("near")[0].as_py(), shard.column("width")[0].as_py()):
        links = np.frombuffer(raw, np.int32).reshape(-1, width).copy()
        links[lost[lost < len(links)]] = -1
        links[np.isin(links, lost)] = -1
        near.append(links.tobytes())
    shard = shard.set_column(shard.column_names.index("near"), "near", pa.array([near]))
    got = embedding_dedup._looker(0.95, 0.99, 32)(pa.table(columns).select(["class", "embedding"]), shard)
    links = dict(zip(got.column("class").to_pylist(), got.column("links").to_pylist()))
    assert [links.get(i, 0) for i in range(n)] == [hot - 1] * hot + [1] * (2 * pairs)


def test_a_large_group_of_near_vectors_fills_no_memory(monkeypatch):
    """all pairs of a group were held at once, which grows with the square of the group."""
    draw = np.random.default_rng(2)
    given = (draw.normal(size=32) + 0.02 * draw.normal(size=(2500, 32))).astype(np.float32)
    columns = {"dim": [32] * 2500, "shard": [0] * 2500, "class": list(range(2500)), "copies": [1] * 2500}
    table = pa.table(columns | {"embedding": pa.ListArray.from_arrays(pa.array(np.arange(2501) * 32, pa.int32()), given.ravel())})
    monkeypatch.setattr(embedding_dedup, "HITS", 1 << 16, raising=False)
    monkeypatch.setattr(embedding_dedup, "FOREST", 1 << 18, raising=False)
    shard = embedding_dedup._build(table)
    tracemalloc.start()
    try:
        got = embedding_dedup._looker(0.95, 0.99, 32)(table.select(["class", "embedding"]), shard)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 2500 and set(got.column("links").to_pylist()) == {2499} and set(got.column("root").to_pylist()) == {0}
    assert most < 100 << 20


def test_graphs_are_not_sent_to_their_queries(spark, monkeypatch):
    """each graph went through the shuffle once per slot of queries, and a task sorted rows of that size."""
    monkeypatch.setattr(embedding_dedup, "QUERIES", 32)
    draw = np.random.default_rng(4)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors(draw, (40, 25), 2000))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = embedding_dedup.link_embeddings(frame)
    assert got.agg({"n_links": "sum"}).first()[0] == 40 * 39 + 25 * 24
    assert written() - before < 20 * len(rows) * 16 * 4
