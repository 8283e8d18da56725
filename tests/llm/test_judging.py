import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from texts import HARD

from cloakwork.llm import batches as B
from cloakwork.llm import license_scan, packing, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENCES = [
    "This is CC BY. cc-by cc by", "the GNU General Public License version 3, all rights reserved", "All rights\nreserved all rights reserved",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (", "licensed under cc by-nc 4.0", "licence word license public",
    "This work is licensed under the GNU General Public License, version 3. All Rights Reserved", "apache license version 2", "écc by", "cc by", None, "",
]


def test_licences_as_by_brute_force(spark, documents):
    rows = [*enumerate([*LICENCES, *HARD, " ".join(["cc by"] * 3000)]), (None, "cc by"), (0, "cc by")]
    got = sorted(
        (str(r["doc_id"]), r["n_words"], sorted((m["label"], m["base"], m["start"], round(m["score"], 9)) for m in r["matches"]))
        for r in license_scan.scan(documents(rows)).collect()
    )

    def by_hand(text):
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        found = []
        for t in license_scan.BASE + license_scan.WORDINGS:
            for start in range(len(words)):
                fits = [start + j < len(words) and words[start + j] == w for j, w in enumerate(t.tokens)]
                if all(fits[j] for j in t.needed) and sum(fits) / len(fits) >= t.share:
                    found.append((t.label, t.base, start, round(sum(fits) / len(fits), 9)))
        return len(words), sorted(found)

    assert got == sorted((str(i), *by_hand(t)) for i, t in rows)
    assert license_scan.scan(documents([])).count() == 0


def test_quality_counts_by_hand(spark, documents):
    draw = random.Random(2)
    made = [" ".join(draw.choice(["a", "b", "c#", "Dé", "1"]) + draw.choice(["", "\n", "\t"]) for _ in range(draw.randint(0, 60))) for _ in range(80)]
    rows = list(enumerate([*HARD, *made]))
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(rows), quality_rules.DecisionList()).collect()}
    for i, text in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        covered = {j + k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        row = got[i]["_counts"]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want, text[:50]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert got[i]["_base_failed"] == failed and got[i]["_kept"] == (not failed)


def test_quality_counts_take_little_memory():
    """Slices of 8 MB took some 200 MB of running sums in each worker."""
    text = " ".join(f"word{i % 977} (x)" for i in range(80))
    texts = pa.array([text] * (12_000_000 // len(text)), pa.string())
    quality_rules.counted(texts.slice(0, 10))
    tracemalloc.start()
    got = quality_rules.counted(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and len(set(got.field("n_words").to_pylist())) == 1 and got[0]["n_words"].as_py() == 160
    assert most < 100e6


def test_workers_drop_what_earlier_work_left():
    """Tokenizer and pieces of the packing stage stayed in workers for good, beside the examples of the next stage."""
    made = []
    make = lambda: made.append(1) or [0] * 10
    first = B.in_worker("a", make)
    assert B.in_worker("a", make) is first and len(made) == 1
    B.in_worker("b", make)
    assert list(B._REMEMBERED) == ["b"]
    packing.encoder_in_worker(SimpleNamespace(value=open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()))
    assert len(B._REMEMBERED) == 1
    B.forget()
    assert not B._REMEMBERED and not any(isinstance(v, packing.PieceEncoder) for v in vars(packing).values())


def test_rules_are_learned_and_equal_their_spark_form(spark, documents):
    draw = np.random.default_rng(1)
    values = {name: draw.random(3000) for name in quality_rules.shares()}
    keep = ~((values["symbols_per_word"] > 0.7) & (values["upper_share"] < 0.5) | (values["repeat_share"] > 0.9))
    rules = quality_rules.sequential_covering(values, keep)
    assert (rules.decide(values) == keep).mean() > 0.98 and rules.rules
    rows = [(i, "W# " * (i % 7) + "some words that differ " * (i % 5)) for i in range(60)]
    judged = quality_rules.with_counts(documents(rows)).select("doc_id", *[c.alias(n) for n, c in quality_rules.shares().items()], rules.column(quality_rules.shares()).alias("k"))
    table = judged.toPandas()
    assert (rules.decide({n: table[n].to_numpy(float) for n in quality_rules.shares()}) == table["k"].to_numpy()).all()


def test_learning_without_labels_keeps_all(spark, documents):
    none = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "some text"), (2, None)])
    assert quality_rules.learn_rules(docs, none).rules == ()
    assert quality_rules.judge(documents([]), quality_rules.DecisionList()).count() == 0
    judge = toxicity.learn(docs, none)
    scores = [r["_toxicity"]["score"] for r in toxicity.score(docs, judge).collect()]
    assert scores == [0.5, 0.5]


def test_quality_rules_on_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn_rules(docs, labels)
    judged = quality_rules.judge(docs, rules).join(labels, "doc_id").where(~F.col("_base_failed"))
    seen = {(r["quality"], r["_kept"]): r["count"] for r in judged.groupBy("quality", "_kept").count().collect()}
    assert seen.get((1, False), 0) <= 0.01 * seen[1, True] and seen.get((0, True), 0) <= 0.3 * (seen.get((0, False), 0) + 1)


def test_nearest_is_exact():
    draw = np.random.default_rng(4)
    width, vectors = 40, []
    for _ in range(500):
        column = np.sort(draw.choice(width, draw.integers(1, 6), replace=False))
        weight = draw.random(len(column)) + 0.1
        vectors.append((column, weight / np.linalg.norm(weight)))
    vectors += vectors[:30]  # ties
    dense = np.zeros((len(vectors), width))
    for i, (c, w) in enumerate(vectors):
        dense[i, c] = w
    index = toxicity.BlockMaxIndex(vectors, width)
    for i in range(0, 500, 7):
        cosine = np.round(dense @ dense[i], 12)
        want = [j for j in sorted(range(len(vectors)), key=lambda j: (-cosine[j], j)) if cosine[j] > 0 and j != i][:9]
        found, scores = index.nearest(*vectors[i], 9, but=i)
        assert found.tolist() == want and np.allclose(scores, np.minimum(cosine[want], 1))


def test_scores_follow_tf_idf_by_hand(spark, documents):
    rows = [(i, f"idiot w{i} common" if i % 4 == 0 else f"nice w{i} common") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1)], "doc_id long, toxic int")
    docs = documents(rows)
    judge = toxicity.learn(docs, labels)
    idf = math.log(81 / 21) + 1
    assert math.isclose(judge.space.idf[judge.space.columns["idiot"]], idf)
    asked = documents([(1, "You IDIOT!"), (2, "so nice"), (3, None), (4, ""), (5, "nothing known"), (5, "nothing known"), (None, "idiot")])
    got = [(r["doc_id"], r["_toxicity"]["score"], r["_toxicity"]["evidence"]) for r in toxicity.score(asked, judge).collect()]
    by = {i: s for i, s, _ in got}
    assert by[1] > 0.9 and by[2] < 0.1 and by[None] > 0.9 and by[3] == by[4] == by[5] and 0 <= by[3] <= 1
    assert all(e["toxic"] and e["cosine"] > 0.3 for i, _, near in got if i == 1 for e in near)
    assert toxicity.score(documents([]), judge).count() == 0


def test_nearest_is_exact_over_rare_and_common_columns():
    draw = np.random.default_rng(5)
    width, vectors = 3000, []
    for _ in range(700):
        column = np.unique(np.concatenate([draw.choice(30, 6), draw.integers(30, width, 8)]))
        weight = draw.random(len(column)) + 0.1
        vectors.append((column, weight / np.linalg.norm(weight)))
    dense = np.zeros((len(vectors), width))
    for i, (c, w) in enumerate(vectors):
        dense[i, c] = w
    index = toxicity.BlockMaxIndex(vectors, width)
    assert 0 < len(index.table) < width and len(index.row)
    for i, (found, scores) in zip(range(0, 700, 3), index.nearest_of_each(vectors[::3], 9, list(range(0, 700, 3)))):
        cosine = np.round(dense @ dense[i], 12)
        want = [j for j in sorted(range(len(vectors)), key=lambda j: (-cosine[j], j)) if cosine[j] > 0 and j != i][:9]
        assert found.tolist() == want and np.allclose(scores, np.minimum(cosine[want], 1))


def test_bounds_that_rule_out_nothing_are_left(monkeypatch):
    """They were computed for every vector; without them the sums are the same, and they are tried again later."""
    draw = np.random.default_rng(13)
    vectors = []
    for _ in range(1200):
        column = np.sort(draw.choice(3000, 40, replace=False))
        weight = draw.random(40) + 0.5
        vectors.append((column, weight / np.sqrt((weight**2).sum())))
    monkeypatch.setattr(toxicity, "DENSE_BYTES", 0)
    given, but = vectors[:150], list(range(150))
    monkeypatch.setattr(toxicity, "TRIED", 10**9)
    always = toxicity.BlockMaxIndex(vectors, 3000)
    wanted = always.nearest_of_each(given, 9, but)
    monkeypatch.setattr(toxicity, "TRIED", 8)
    index, read = toxicity.BlockMaxIndex(vectors, 3000), []
    monkeypatch.setattr(toxicity.BlockMaxIndex, "_read", lambda self, *a, f=toxicity.BlockMaxIndex._read: read.append(1) or f(self, *a))
    for (found, scores), (theirs, same) in zip(index.nearest_of_each(given, 9, but), wanted):
        assert found.tolist() == theirs.tolist() and scores.tolist() == same.tolist()
    assert always.unbound == 0 and 8 <= len(read) < 20


def test_driver_holds_hashes_and_counts_but_no_index(spark, documents):
    """The driver's share: 20 bytes a term and 5 to 8 a posting; weights come back from counts, of 255 and more too."""
    rows = [(i, " ".join(f"w{i}x{n}" for n in range(200)) + (" bad" * 300 if i % 4 == 0 else " good")) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    judge = toxicity.learn(documents(rows), labels)
    assert "index" not in vars(judge) and not isinstance(judge.space.columns, dict)
    of, columns = judge.examples, judge.space.columns
    assert columns.hashes.nbytes + columns.sorted.nbytes + columns.order.nbytes == 20 * len(columns) > 20 * 40 * 200
    assert of.column.nbytes + of.count.nbytes <= 8 * int(of.lengths.sum()) and of.count.max() == 300
    row, column, weight = judge.space.vectors(pa.array([rows[int(i)][1] for i in judge.ids]))
    assert column.tolist() == of.column.tolist() and weight.tolist() == judge.weights.tolist()
    assert np.bincount(row).tolist() == of.lengths.tolist()


def test_rare_words_of_examples_count(spark, documents):
    """Each toxic word stands in one example only: a near copy of that example is still found by it."""
    rows = [(i, f"slur{i:02d}x common words here" if i % 4 == 0 else f"nice{i:02d}x common words here") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    judge = toxicity.learn(documents(rows), labels)
    got = {r["doc_id"]: r["_toxicity"]["evidence"] for r in toxicity.score(documents([(1, "such a SLUR08X"), (2, "nice05x")]), judge).collect()}
    assert got[1][0]["example"] == "8" and got[1][0]["toxic"] and got[1][0]["cosine"] > 0.5
    assert got[2][0]["example"] == "5" and not got[2][0]["toxic"]


def plain_terms(word):
    word = word.lower().strip(toxicity.EDGES)
    return [word, *("^" + word[:n] if len(word) > n else None for n in toxicity.PREFIXES)] if word else [None] * 4


def test_terms_of_all_words_at_once_as_word_by_word():
    """They were made word by word in Python, and a worker remembered 300,000 of them."""
    every = [chr(c) for c in range(33, 0x3000) if not chr(c).isspace()] + ["\U00010400", "\U0001f600"]
    words = [f"Ab{c}dEfg" for c in every] + [*every, "İΣΑΣ", "ΟΔΟΣ", "«Straße»", "...", "\"(don't)!", "x" * 40_000, "É" * 7]
    for some in (words, ["Plain", "words,"], []):
        got = zip(*(t.to_pylist() for t in toxicity.terms(pa.array(some, pa.string()))))
        assert [list(g) for g in got] == [plain_terms(w) for w in some]


def test_hashes_tell_strings_apart_wherever_they_lie():
    made = ["", "a", "a\0", "\0a", "\0", "\0" * 8, "\0" * 9, *("abcdefgh" * n + "x" * m for n in range(4) for m in range(8)), "é" * 300]
    strings = pa.array(made, pa.string())
    whole = B.hashes(strings)
    assert len(set(whole.tolist())) == len(set(made))
    assert B.hashes(strings.slice(3, 20)).tolist() == whole[3:23].tolist()
    assert [int(B.hashes(pa.array([x]))[0]) for x in made] == whole.tolist()
    assert len(B.hashes(pa.array([], pa.string()))) == 0


def test_index_takes_few_bytes_for_a_posting(spark, documents, monkeypatch):
    """They were 12 for each and 20 for each run, and 8 more for the weights of the examples."""
    monkeypatch.setattr(toxicity, "DENSE_BYTES", 0)
    draw = random.Random(7)
    rows = [(i, " ".join(f"{draw.randrange(4000):04d}" for _ in range(300)) + (" bad" if i % 2 else " good")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    judge = toxicity.learn(documents(rows), labels)
    index, width = judge.index, len(judge.space.columns)
    held = [v for v in vars(index).values() if isinstance(v, np.ndarray)]
    postings = int(judge.examples.lengths.sum())
    assert sum(v.nbytes for v in held if v.ndim == 1 and len(v) > 2 * width) <= 10 * postings > 0
    column, weight = judge.example(5)
    assert np.allclose(weight, judge.weights[index.ends[5] : index.ends[6]], rtol=1e-12) and index.nearest(column, weight, 1)[0].tolist() == [5]


def test_nearest_beyond_the_precision_of_the_table():
    """Cosines that 32-bit sums can't tell apart still come in their order, and copies tie by number."""
    base = np.linspace(1, 2, 40)
    vectors = []
    for i in range(300):
        weight = base.copy()
        weight[0] += ((i * 7) % 100) * 1e-7
        vectors.append((np.arange(40), weight / np.linalg.norm(weight)))
    index = toxicity.BlockMaxIndex(vectors, 40)
    assert len(index.table) == 40
    asked = np.zeros(40)
    asked[0] = 1.0
    asked = base * 0.1 + asked
    asked /= np.linalg.norm(asked)
    cosine = np.round([asked @ w for _, w in vectors], 12)
    want = sorted(range(300), key=lambda j: (-cosine[j], j))[:15]
    for found, scores in index.nearest_of_each([(np.arange(40), asked)] * 30, 15):
        assert found.tolist() == want and np.allclose(scores, cosine[want], rtol=0, atol=2e-12)


def test_isotonic_levels_rise():
    votes, toxic = np.array([0.0, 0.1, 0.1, 0.4, 0.5, 0.9]), np.array([0, 1, 0, 0, 1, 1.0])
    steps, levels = toxicity.rising_steps(votes, toxic, np.ones(6))
    assert (np.diff(levels) > 0).all() and (np.diff(steps) > 0).all() and ((levels > 0) & (levels < 1)).all()


def test_held_out_accuracy(spark):
    from cloakwork.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_licence_sql_on_given_documents(spark):
    from cloakwork.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    frame = QUERIES["op3_license_scan"](spark, folder)
    cursor = con.execute(ORACLES["op3_license_scan"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in frame.collect()))) == sorted(map(str, cursor.fetchall()))


def test_counts_of_one_slice_equal_those_of_many():
    texts = pa.array([t for t in HARD for _ in range(2)], pa.string())
    together = quality_rules.count_features(texts)
    alone = [quality_rules.count_features(texts.slice(i, 1)) for i in range(len(texts))]
    for name, values in together.items():
        assert values.tolist() == [int(a[name][0]) for a in alone]


def test_licence_wordings_that_begin_before_the_text(documents):
    rows = [(1, "The MIT License applies here"), (2, "mit license"), (3, "so: The MIT License applies"), (4, "license applies"), (5, "")]
    got = {r["doc_id"]: [(m["label"], m["start"]) for m in r["matches"]] for r in license_scan.scan(documents(rows)).collect()}
    assert got[1] == [("mit", 0)] and got[3] == [("mit", 0)] and got[4] == got[5] == []
