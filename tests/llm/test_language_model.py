import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import HARD

from cloakwork.llm import language_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = "\n", "\n\n"


def tokens(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [END]


def counts(texts, order):
    out = [Counter() for _ in range(order)]
    for words in texts:
        line = [START, *words]
        out[0].update(line)
        for n in range(2, order + 1):
            out[n - 1].update(tuple(line[i - n + 1 : i + 1]) for i in range(n - 1, len(line)))
    return out


def estimates(words, c, total, distinct, order):
    """(bucket, estimates of the longest order first, uniform last) of each token."""
    line = [START, *words]
    for i in range(1, len(line)):
        row, longest = [], 0
        for n in range(order, 1, -1):
            context = line[i - n + 1 : i] if i - n + 1 >= 0 else None
            seen = 0 if context is None else (c[n - 2][context[0]] if n == 2 else c[n - 2][tuple(context)])
            row.append(c[n - 1][tuple(line[i - n + 1 : i + 1])] / seen if seen else 0.0)
            longest = seen if n == order else longest
        yield (1 + int(math.log2(longest)) if longest else 0), [*row, c[0][line[i]] / max(1, total), 1 / (distinct + 1)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_as_by_dictionaries(spark, documents, order, monkeypatch):
    texts = [*HARD, *("the cat sat on the %s mat" % w for w in "red old big red old wet".split()), *("A b a b c %d" % (i % 5) for i in range(40))]
    rows = list(enumerate(texts))
    train, held = F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1
    fitted = {}

    def fit(cells, n, rounds=60, real=language_model.fit_weights):
        fitted["weights"] = real(cells, n, rounds)
        fitted["cells"] = cells
        return fitted["weights"]

    monkeypatch.setattr(language_model, "fit_weights", fit)
    got = {r["doc_id"]: r for r in language_model.score(documents(rows), train, held, order).collect()}
    learned = [tokens(t) for i, t in rows if i % 5 != 0]
    c = counts(learned, order)
    total, distinct = sum(map(len, learned)), len(c[0]) - 1
    gone = counts([tokens(t) for i, t in rows if i % 5 == 1], order)
    less = [a - b for a, b in zip(c, gone)]
    n_gone = sum(len(tokens(t)) for i, t in rows if i % 5 == 1)
    cells = [e for i, t in rows if i % 5 == 1 for e in estimates(tokens(t), less, total - n_gone, distinct, order)]
    # the histogram holds all held-out tokens and their estimates
    assert sum(n for _, n, _ in fitted["cells"]) == len(cells)
    for j in range(order + 1):
        assert math.isclose(sum(n * p[j] for _, n, p in fitted["cells"]), sum(p[j] for _, p in cells), rel_tol=1e-9)
    for i, text in rows:
        words, row = tokens(text), got[i]
        base = sum(math.log10((c[0][w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        model = sum(math.log10(np.dot(fitted["weights"][b], p)) for b, p in estimates(words, c, total, distinct, order))
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(c[0][w] > 0 for w in words), total)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], model, rel_tol=1e-9)


def test_weights_find_the_mixture():
    draw = np.random.default_rng(1)
    true, p = np.array([0.6, 0.3, 0.1]), draw.dirichlet(np.ones(3), 4000)
    chosen = draw.random(4000) < p @ true  # tokens that the mixture makes likely
    weights = language_model.fit_weights([(3, 1.0, list(x)) for x in p[chosen]], 2, 400)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and weights[3].argmax() == 0
    assert np.allclose(weights[3], weights[10])


def test_nothing_to_learn_and_nothing_to_score(spark, documents):
    docs = documents([(1, "a b"), (None, None), (1, "a b")])
    got = language_model.score(docs, F.lit(False), F.lit(None).cast("boolean")).collect()
    assert [r["train_tokens"] for r in got] == [0, 0, 0] and all(abs(r["score"]) < 1e-9 for r in got)
    only = language_model.score(docs, F.lit(True), F.lit(False)).collect()
    assert sorted(str(r["doc_id"]) for r in only) == ["1", "1", "None"] and all(r["score"] < 0 for r in only)
    empty = language_model.score(documents([]), F.lit(True), F.lit(False))
    assert empty.count() == 0


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    from cloakwork.llm.queries import QUERIES

    rows = [r for r in QUERIES["op7_lm_scores"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
