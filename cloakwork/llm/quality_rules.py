"""Quality of documents: whole-text statistics and a decision list learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm import batches as B

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits",
    "n_marks",
]
WHITE, SYMBOL, UPPER, DIGIT, MARK, INSIDE = 1, 2, 4, 8, 16, 32
REPEAT_WINDOW = 5
SLICE = 2 << 20  # bytes of text counted at once; running sums over characters take some 25 times as much


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for chars, bit in (
        (b" \t\n\x0b\x0c\r", WHITE), (b"#*$%&|<>", SYMBOL), (bytes(range(65, 91)), UPPER), (bytes(range(48, 58)), DIGIT),
        (b"!\"'(),-./:;?@[\\]^_`{}~+=", MARK), (bytes(range(0x80, 0xC0)), INSIDE),  # INSIDE: later bytes of a character
    ):
        table[list(chars)] |= bit
    return table


BYTE_CLASSES = _byte_classes()


def _spread(numbers: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated_window_words(codes: np.ndarray, offsets: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words found twice or more in that text.

    Windows are sorted by a 64-bit hash of their words and text; neighbours count as equal only if all words are equal.
    """
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.arange(len(codes)) + size <= np.repeat(offsets[1:], lengths))
    mixed = _spread(np.arange(int(codes.max()) + 1)) if len(codes) else np.zeros(0, np.uint64)
    value = _spread(text[starts])
    for step in range(size):
        value = value * np.uint64(0x100000001B3) + mixed[codes[starts + step]]
    order = np.argsort(value, kind="stable")
    ranked, first = value[order], starts[order]
    twin = np.flatnonzero(ranked[1:] == ranked[:-1])
    a, b = first[twin], first[twin + 1]
    equal = text[a] == text[b]
    for step in range(size):
        equal &= codes[a + step] == codes[b + step]
    found = np.concatenate([a[equal], b[equal]])
    change = np.zeros(len(codes) + 1, np.int64)
    marked = np.unique(found)
    change[marked] += 1
    np.subtract.at(change, marked + size, 1)
    return B.sums((np.cumsum(change[:-1]) > 0).astype(np.int64), offsets)


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each whole text; null is empty."""
    texts = pc.fill_null(texts, "")
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds, kind = bounds - bounds[0], BYTE_CLASSES[data]
    count = lambda mask: B.sums(mask.view(np.int8), bounds)
    out = {
        "word_chars": count((kind & (WHITE | INSIDE)) == 0), "n_symbols": count((kind & SYMBOL) != 0),
        "n_upper": count((kind & UPPER) != 0), "n_digits": count((kind & DIGIT) != 0), "n_marks": count((kind & MARK) != 0),
    }
    _, codes, offsets = B.word_codes(texts)
    out["n_words"] = np.diff(offsets)
    out["n_repeat_words"] = repeated_window_words(codes, offsets)
    out["n_distinct_words"] = _distinct(codes, offsets)
    lines, line_codes, line_offsets = B.codes_of(pc.split_pattern(texts, "\n"))
    worded = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)[line_codes]
    line_offsets = np.concatenate([[0], np.cumsum(worded)])[line_offsets]
    out["n_lines"] = np.diff(line_offsets)
    out["n_dup_lines"] = out["n_lines"] - _distinct(line_codes[worded], line_offsets)
    return out


def _distinct(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct codes of each text."""
    lengths = np.diff(offsets)
    if not len(codes):
        return np.zeros(len(lengths), np.int64)
    width = int(codes.max()) + 1
    seen = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + codes)
    return np.bincount(seen // width, minlength=len(lengths))


def counted(whole: pa.Array) -> pa.Array:
    """A struct of COUNTS for each text."""
    done = []
    for part in B.slices([pa.RecordBatch.from_arrays([whole], ["text"])], 0, SLICE):
        found = count_features(part.column(0))
        done.append(pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], COUNTS))
    return pa.concat_arrays(done) if done else pa.array([], pa.struct([(c, pa.int64()) for c in COUNTS]))


def with_counts(docs: DataFrame, text_column: str = "text", into: str = "_counts") -> DataFrame:
    """The rows with a struct of COUNTS; evaluated once per row, whatever reads it."""

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        B.forget()
        yield from map(counted, parts)

    return docs.withColumn(into, counts.asNondeterministic()(F.col(text_column).cast("string")))


def shares(counts: str = "_counts") -> dict[str, Column]:
    """What the rules may test: counts set against the size of the text."""
    c = lambda name: F.col(f"{counts}.{name}")
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word_chars": per(c("word_chars"), c("n_words")),
        "symbols_per_word": per(c("n_symbols"), c("n_words")),
        "marks_per_word": per(c("n_marks"), c("n_words")),
        "upper_share": per(c("n_upper"), c("word_chars")),
        "digit_share": per(c("n_digits"), c("word_chars")),
        "distinct_share": per(c("n_distinct_words"), c("n_words")),
        "repeat_share": per(c("n_repeat_words"), c("n_words")),
        "dup_line_share": per(c("n_dup_lines"), c("n_lines")),
    }


def base_failed(counts: str = "_counts") -> Column:
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.at_least else values < self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    keep: bool
    covered: int
    right: int

    def column(self, features: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [t.column(features) for t in self.tests])

    def __str__(self) -> str:
        said = " and ".join(f"{t.feature} {'>=' if t.at_least else '<'} {t.threshold:.6g}" for t in self.tests)
        return f"if {said}: {'keep' if self.keep else 'reject'} ({self.right} of {self.covered})"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()
    otherwise: bool = True

    def column(self, features: dict[str, Column]) -> Column:
        """The first rule that holds decides: CASE WHEN ... THEN ... ELSE ... END."""
        out = F
        for rule in self.rules:
            out = out.when(rule.column(features), F.lit(rule.keep))
        return out.otherwise(F.lit(self.otherwise)) if self.rules else F.lit(self.otherwise)

    def decide(self, values: dict[str, np.ndarray]) -> np.ndarray:
        size = len(next(iter(values.values())))
        out, open_ = np.full(size, self.otherwise), np.ones(size, bool)
        for rule in self.rules:
            hit = open_ & np.logical_and.reduce([t.holds(values[t.feature]) for t in rule.tests])
            out[hit], open_ = rule.keep, open_ & ~hit
        return out


def grow(values: dict[str, np.ndarray], wanted: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Test]:
    """Add the test with the largest gain of information until only wanted rows are left, or ``most`` tests stand."""
    tests: list[Test] = []
    inside = np.ones(len(wanted), bool)
    while len(tests) < most and (inside & ~wanted).any():
        p, n = (inside & wanted).sum(), (inside & ~wanted).sum()
        best = (0.0, None)
        for name, points in cuts.items():
            x = values[name]
            hit, miss = np.sort(x[inside & wanted]), np.sort(x[inside & ~wanted])
            below_p, below_n = np.searchsorted(hit, points), np.searchsorted(miss, points)
            for at_least, ps, ns in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p / (p + n))), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), Test(name, at_least, float(points[i])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(values[best[1].feature])
    return tests


def prune(tests: list[Test], values: dict[str, np.ndarray], wanted: np.ndarray) -> list[Test]:
    """Drop last tests while (right - wrong) / covered on the rows kept back does not fall."""

    def worth(kept: list[Test]) -> float:
        hit = np.logical_and.reduce([t.holds(values[t.feature]) for t in kept])
        return (2 * (hit & wanted).sum() - hit.sum()) / max(1, hit.sum())

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def sequential_covering(
    values: dict[str, np.ndarray], keep: np.ndarray, most_rules: int = 16, most_tests: int = 4, precision: float = 0.9,
    least: int = 5, points: int = 128,
) -> DecisionList:
    """Rules for rejection, one after the other, each on the rows that the rules before it leave.

    Two rows of three grow a rule, the third is kept back to prune it. A rule enters the list if it covers at least ``least``
    rows and is right on ``precision`` of those kept back, so rows are rejected on evidence only; all else is kept.
    """
    size, rules = len(keep), []
    if not size:
        return DecisionList()
    back = np.arange(size) % 3 == 2
    open_ = np.ones(size, bool)
    while len(rules) < most_rules:
        learn, test = open_ & ~back, open_ & back
        if (learn & ~keep).sum() < least:
            break
        part = {f: v[learn] for f, v in values.items()}
        steps = np.linspace(0, 1, points)
        cuts = {f: np.unique(np.concatenate([np.quantile(v, steps), np.quantile(v[~keep[learn]], steps)])) for f, v in part.items()}
        tests = grow(part, ~keep[learn], cuts, most_tests)
        if not tests:
            break
        tests = prune(tests, {f: v[test] for f, v in values.items()}, ~keep[test])
        hit = np.logical_and.reduce([t.holds(values[t.feature]) for t in tests]) & open_
        right, held = (hit & ~keep).sum(), (hit & back).sum()
        if hit.sum() < least or right < precision * hit.sum() or (hit & back & ~keep).sum() < precision * held:
            break
        rules.append(Rule(tuple(tests), False, int(hit.sum()), int(right)))
        open_ &= ~hit
    return DecisionList(tuple(rules), True)


def learn_rules(
    docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", **covering,
) -> DecisionList:
    """Decision list from at most ``most_rows`` labelled documents, those with the least hash of their id.

    That bound is the only sample here: it limits what the driver holds (ten numbers a row). Null ids and labels are left
    out; an id labelled twice counts as good if most of its labels say so. Without labelled rows the list keeps everything.
    """
    votes = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id"))
    chosen = votes.agg((F.avg(label_column) >= 0.5).alias("_keep")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = with_counts(rows, "_text").select(F.xxhash64("_id").alias("_h"), "_keep", *[v.alias(n) for n, v in shares().items()])
    table = rows.orderBy("_h", *shares()).limit(2 * most_rows).toPandas()  # repeated documents at most double the bound
    values = {name: table[name].to_numpy(float) for name in shares()}
    return sequential_covering(values, table["_keep"].to_numpy(bool), **covering)


def judge(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_counts``, ``_base_failed`` and ``_kept``; a column of such a name is replaced.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, null ids like others; an empty
    table stays empty. Texts are read whole, in slices of bounded bytes.
    """
    out = with_counts(docs, text_column).withColumn("_base_failed", base_failed())
    return out.withColumn("_kept", F.when(F.col("_base_failed"), False).otherwise(rules.column(shares())))
