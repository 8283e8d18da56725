"""Spelling variants, bit planes and shared lines beside plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from texts import HARD

from cloakwork.llm import bit_planes, line_dedup, spelling

UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants_by_hand(words, times=2):
    near = {w: sorted((-words[v], v) for v in words if one_edit(w, v)) for w in words}
    form = {w: v[0][1] if v and -v[0][0] >= times * words[w] else None for w, v in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else -1) for w in words)


def as_rows(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in frame.collect())


def words_by_hand(rows, least_chars=5, least_count=3, damage=97):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER_TO_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count and len(w) >= least_chars}


def test_one_edit_by_hand():
    assert one_edit("abc", "abd") and one_edit("abc", "ab") and one_edit("aab", "ab") and one_edit("b", "ab") and one_edit("", "a")
    assert not one_edit("abc", "abc") and not one_edit("ab", "ba") and not one_edit("abc", "a")


def test_whole_neighbourhoods():
    alphabet = np.array([1, 2, 3], np.uint64)
    words = [(1, 1, 2), (3, 3, 3), (1, 2, 3), (2, 1, 2)]
    got = defaultdict(list)
    for row, key in spelling.neighbour_keys(np.array(words, np.uint64), alphabet):
        for r, k in zip(row.tolist(), key.tolist()):
            got[r].append(k)
    power = [pow(int(spelling.FACTOR), i, 1 << 64) for i in range(5)]
    for r, w in enumerate(words):
        want = {w} | {w[:i] + w[i + 1 :] for i in range(3)} | {w[:i] + (c,) + w[i + 1 :] for i in range(3) for c in (1, 2, 3)}
        want |= {w[:i] + (c,) + w[i:] for i in range(4) for c in (1, 2, 3)}
        assert sorted(got[r]) == sorted(sum(c * p for c, p in zip(v, power)) % (1 << 64) for v in want)


def some_texts(draw):
    base = ["".join(draw.choice("abcdeéüinorst") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    texts = list(HARD)
    for _ in range(80):
        words = [draw.choice(base) for _ in range(40)]
        for _ in range(4):
            at = draw.randrange(40)
            i = draw.randrange(len(words[at]))
            words[at] = words[at][:i] + draw.choice(["", "e", "x", words[at][i] * 2]) + words[at][i + 1 :]
        texts.append(draw.choice([" ", "-", "1"]).join(words).title() if draw.random() < 0.2 else " ".join(words))
    return texts


def test_variants_as_by_brute_force(spark, documents):
    rows = [*enumerate(some_texts(random.Random(4))), (None, "without an id without"), (3, "again again again")]
    for damage in (97, 3, None):
        words = words_by_hand(rows, damage=damage)
        assert words
        got = spelling.spelling_variants(documents(rows), damage=damage)
        assert as_rows(got) == variants_by_hand(words)
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, None), (2, "")])).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_many_words_of_one_reduced_word(spark, monkeypatch, bucket):
    """Letters of one symbol: all words of a length share their reduced word, on two levels."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    draw = random.Random(8)
    same = [chr(c) for c in range(0xC0, 0x100) if c % 36 == 12] + ["Æ", "Ì"]  # Ð, ô share 12 of 36; Æ, Ì share 0 of 6
    words = {"".join(draw.choice(same) for _ in range(draw.randint(6, 8))): draw.randint(3, 60) for _ in range(250)}
    words |= {w[:2] + "z" + w[2:]: 2 * n for w, n in list(words.items())[:20]}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_rows(spelling.group_variants(frame)) == variants_by_hand(words)


def test_long_chains_and_long_words(spark):
    words = {"a" * 5 + "b" * i: 3 << i for i in range(12)}
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(30_000))
    words |= {long: 10, long[:7_000] + long[7_001:]: 4, long[:29_000] + "q" + long[29_001:]: 3, long + "zz": 7}
    got = as_rows(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == variants_by_hand(words)
    assert got[0][2] == "a" * 5 + "b" * 11
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), times=1)


@pytest.mark.parametrize("low, high", [(-1, 1), (0, 1), (-64, 65), (-3, 300), (-(1 << 24), (1 << 24))])
def test_products_by_planes(low, high):
    draw = np.random.default_rng(5)
    a, b = draw.integers(low, high, (40, 64)), draw.integers(low // 2, high, (7, 64))
    assert (bit_planes.dots(bit_planes.to_planes(a), bit_planes.to_planes(b)) == a @ b.T).all()
    assert (bit_planes.squared_lengths(bit_planes.to_planes(a)) == (a * a).sum(1)).all()
    cluster = draw.integers(0, 5, 40)
    assert (bit_planes.component_sums(bit_planes.to_planes(a), cluster, 6) == [a[cluster == k].sum(0) for k in range(6)]).all()


def test_planes_of_a_slice():
    draw = np.random.default_rng(6)
    narrow, wide = bit_planes.to_planes(draw.integers(-2, 2, (30, 64))), bit_planes.to_planes(draw.integers(-99, 99, (20, 64)))
    batch = pa.RecordBatch.from_pydict({"planes": pa.array([*narrow.view(np.int64).tolist(), *wide.view(np.int64).tolist()])})
    assert (bit_planes._read(batch.slice(30, 20)) == wide).all()
    assert (bit_planes._read(batch.slice(7, 9)) == narrow[7:16]).all()
    mixed = bit_planes._read(batch.slice(25, 10))
    assert (bit_planes.squared_lengths(mixed)[:5] == bit_planes.squared_lengths(narrow[25:])).all()


def clusters_by_hand(rows, clusters=16, rounds=3, seed="1"):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:clusters]]

    def near(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, centre)), k) for k, centre in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, k in last:
        total[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, total[k], sum(total.values()), digest[k]) for i, d, k in last)


def test_clusters_as_by_brute_force(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(20, 64))
    good = [(centres[draw.integers(20)] + 0.3 * draw.normal(size=64)).astype(np.float32).tolist() for _ in range(300)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("-inf")] + [1.0] * 63, [0.0] * 64]
    rows = [*enumerate(good + good[:3] + odd), (None, good[5]), (4, good[9]), (4, good[4])]
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id int, cluster string, planes string")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def told(data, **how):
        return sorted((str(r[0]), *r[1:]) for r in bit_planes.cluster_vectors(data, **how).select(columns).collect())

    assert told(frame) == clusters_by_hand(rows)
    assert told(frame.where("vec_id < 5 OR vec_id IS NULL")) == clusters_by_hand([r for r in rows if r[0] is None or r[0] < 5])
    assert told(frame, clusters=2, rounds=0, seed="s") == clusters_by_hand(rows, 2, 0, "s")
    none = bit_planes.cluster_vectors(frame.limit(0))
    assert none.columns == columns and none.count() == 0
    wide = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="outside"):
        bit_planes.cluster_vectors(wide)


def lines_by_hand(rows, least_chars=40, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER_TO_LOWER)

    holders = defaultdict(set)
    for i, text in set(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].add((i, text))
    low = lambda i: (i is not None, i or 0)
    last = {k: max((i for i, _ in h), key=low) for k, h in holders.items() if len(k) >= least_chars and len(h) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 1000])
def test_lines_as_by_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    draw = random.Random(2)
    shared = [" ".join("Word%d" % draw.randrange(99) for _ in range(n)) for n in (3, 7, 8, 9, 12, 30)] + ["İ" * 40, "x" * 40, "y" * 39]
    rows = list(enumerate(HARD))
    for i in range(100, 160):
        lines = [draw.choice([*shared, *shared, "", "own line %d of a text that nobody else has at all" % i]) for _ in range(draw.randint(1, 9))]
        lines = [draw.choice(["", " ", "\t\x0b"]) + draw.choice([x, x.upper(), x]) + draw.choice(["", "\r", " "]) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(None, shared[3] + "\nnull"), (None, "only in null ids, but in five of them: %s\n" % shared[5]), (159, shared[2]), (159, shared[3]), rows[-1], rows[-2]]
    rows += [(None, f"a line that only rows without an id have, in six of them\n{i}") for i in range(6)]
    rows += [(200 + i, shared[4]) for i in range(6)] + [(300 + i, f"{shared[4]}\n" * 3000) for i in range(3)]
    got = line_dedup.drop_shared_lines(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got) == lines_by_hand(rows)
    assert line_dedup.drop_shared_lines(documents([])).count() == 0
    few = line_dedup.drop_shared_lines(documents(rows), least_chars=3, least_docs=2).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in few) == lines_by_hand(rows, 3, 2)
