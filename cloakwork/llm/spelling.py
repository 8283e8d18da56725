"""Spelling variants: words over a reduced alphabet, their whole one-edit neighbourhoods joined, edits verified on the words."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.license_scan import LOWER, UPPER
from cloakwork.session import scratch_path

RUN = "[A-Za-zÀ-ÿ]+"
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])  # what is left of RUN after lower-casing
LEVELS = (6, 36, 256)  # symbols; a letter's symbol is its code point modulo their number, and 256 keeps all letters apart
BUCKET = 64  # words of one reduced word beyond which they are told apart by the next level's larger alphabet
AT_ONCE = 1 << 22  # symbols or neighbours held at once in a task
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def count_words(
    docs: DataFrame, least_chars: int = 5, least_count: int = 3, damage: int | None = 97, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``word, n``: runs of letters, A-Z lower-cased, of at least ``least_chars`` code points, that occur ``least_count`` times.

    With ``damage``, a run whose checksum of ``<id>:<run>`` it divides loses one code point, at the checksum modulo the length;
    a null id counts as an empty one. Occurrences are summed on the map side, so a frequent word is no hot key.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    runs = runs.where(F.char_length("run") >= least_chars).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word: Column = F.col("run")
    if damage:
        sum_ = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (sum_ % F.char_length("run")).cast("int")
        word = F.when(sum_ % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))


def _reduced(words: pa.Array, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of symbols from 1) of the words of each length, in parts of bounded size."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, AT_ONCE // max(1, int(length) * symbols))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, (points[starts[part][:, None] + np.arange(length)] % symbols + 1).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length + 1, FACTOR))])


def _prefixes(matrix: np.ndarray) -> np.ndarray:
    """Hash of every beginning: the sum of symbol times power of its place."""
    sums = np.cumsum(matrix * _powers(matrix.shape[1])[: matrix.shape[1]], axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros((len(matrix), 1), np.uint64), sums], axis=1)


def neighbour_keys(matrix: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of each word itself and of each different word that one deletion, insertion or replacement makes of it.

    Of equal results one is made: a run of equal symbols is shortened at its first place and lengthened before its first one.
    Each hash follows from those of the beginnings, so a long word costs no more than its neighbours; they come place by place.
    """
    rows, length = matrix.shape
    before, power = _prefixes(matrix), _powers(length)
    whole = before[:, -1:]
    yield np.arange(rows), whole[:, 0]
    last = np.concatenate([np.zeros((rows, 1), np.uint64), matrix], axis=1)  # the symbol before each place
    step = max(1, AT_ONCE // max(1, rows * len(alphabet)))
    for start in range(0, length + 1, step):
        at = np.arange(start, min(start + step, length + 1))
        inserted = before[:, at, None] + alphabet * power[at][:, None] + (whole - before[:, at])[:, :, None] * FACTOR
        row, *where = np.nonzero(last[:, at, None] != alphabet)
        yield row, inserted[row, *where]
        at = at[at < length]
        own = matrix[:, at]
        row, where = np.nonzero(last[:, at] != own)
        yield row, (before[:, at] + (whole - before[:, at + 1]) * INVERSE)[row, where]
        replaced = whole[:, :, None] + (alphabet - own[:, :, None]) * power[at][:, None]
        row, *where = np.nonzero(own[:, :, None] != alphabet)
        yield row, replaced[row, *where]


def _keying(symbols: int):
    def add_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for rows, matrix in _reduced(batch.column("word"), symbols):
                key[rows] = _prefixes(matrix)[:, -1]
            yield batch.append_column("key", pa.array(key.view(np.int64)))

    return add_key


def _generating(symbols: int):
    alphabet = np.unique(ALPHABET % symbols + 1).astype(np.uint64)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "part"))
            for rows, matrix in _reduced(batch.column("word"), symbols):
                for row, key in neighbour_keys(matrix, alphabet):
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "own": own[rows[row]], "part": part[rows[row]]})

    return neighbours


def _near_pairs(words: DataFrame, symbols: int, last: bool, folder: str) -> tuple[DataFrame, DataFrame]:
    """(``word, near, n`` found at this level, words that need the next one) of ``word, n, indexed``."""
    spark = words.sparkSession

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(os.path.join(folder, name))
        return spark.read.parquet(os.path.join(folder, name))

    keyed = words.mapInArrow(_keying(symbols), "word string, n long, indexed boolean, key long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.count_if("indexed").alias("held"))
    large = sizes.where((F.col("size") > BUCKET))
    # the words of one reduced word are a row; many are dealt to several rows
    dealt = keyed.join(large, "key", "left").select(
        "key", "word", "n", "indexed", F.coalesce(F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / BUCKET)), F.lit(0)).cast("int").alias("part"),
        (F.lit(not last) & F.coalesce(F.col("held") > BUCKET, F.lit(False))).alias("hot"),
    )
    pair = F.struct("word", "n")
    chunks = kept(
        dealt.groupBy("key", "part").agg(
            F.collect_list("word").alias("words"), F.collect_list(F.when(F.col("indexed") & ~F.col("hot"), pair)).alias("bucket"),
            F.max("hot").alias("hot"),
        ), "chunks",
    )
    asked = chunks.select(F.element_at("words", 1).alias("word"), F.col("key").alias("own"), "part")
    asked = asked.mapInArrow(_generating(symbols), "key long, own long, part int")
    index = chunks.where("NOT hot AND size(bucket) > 0").select("key", "bucket", F.lit(False).alias("hot"))
    index = index.unionByName(chunks.where("hot").select("key", F.lit(None).cast(index.schema["bucket"].dataType).alias("bucket"), "hot").dropDuplicates(["key"]))
    hits = asked.join(index, "key").select("own", "part", "bucket", "hot")
    met = hits.join(chunks.select(F.col("key").alias("own"), "part", "words"), ["own", "part"])
    near = (
        met.where("NOT hot").select("words", F.explode("bucket").alias("b")).select(F.explode("words").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("n"))
        .where(F.levenshtein("word", "near", 1) == 1)
    )
    onward = met.where("hot").select(F.explode("words").alias("word")).distinct()
    if last:
        return kept(near, "near"), spark.createDataFrame([], words.schema)
    hot_words = dealt.where("hot").select("word", F.lit(True).alias("indexed"))
    onward = onward.join(hot_words, "word", "left").join(words.select("word", "n"), "word").select("word", "n", F.coalesce("indexed", F.lit(False)).alias("indexed"))
    return kept(near, "near"), kept(onward, "onward")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, near, n``: for every word of ``word, n`` the words that one edit makes of it, with their n; each pair both ways.

    Letters are hashed to a few symbols. Words within one edit are so over the reduced alphabet too, or equal there; each
    reduced word's whole one-edit neighbourhood (and itself) is looked up among the reduced words by a 64-bit hash, and every
    pair of words behind a hit is verified on the words themselves. Where more than BUCKET words have one reduced word, they
    are not compared there: they, and the words that met them, go on to the next level's larger alphabet; the last one keeps
    all letters apart. So no group of words that look alike is compared pairwise, and no pair is lost.
    """
    spark, folder = vocabulary.sparkSession, scratch_path(vocabulary.sparkSession, "spelling")
    words, found = vocabulary.select("word", "n", F.lit(True).alias("indexed")), []
    for symbols in LEVELS:
        near, words = _near_pairs(words, symbols, symbols == LEVELS[-1], os.path.join(folder, str(symbols)))
        found.append(near)
        if symbols == LEVELS[-1] or words.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """``word, root``: the end of each word's chain of forms, by pointer doubling; a form is more frequent, so chains end."""
    spark, now, round_ = forms.sparkSession, forms.select("word", F.col("form").alias("root")), 0
    while True:
        jumped = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        path = os.path.join(folder, f"jump{round_}")
        jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(path)
        after = spark.read.parquet(path)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now, round_ = after.select("word", "root"), round_ + 1


def group_variants(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``word, n`` (distinct words of RUN's letters, lower-cased).

    ``n_near`` counts the words one edit away. The one of largest n, ties to the smallest in code-point order, is the word's
    form if its n is at least ``times`` (2 or more) the word's; ``root`` ends the chain of forms and is the word itself where it
    has none. No words give no rows.
    """
    if times < 2:
        raise ValueError("with less than twice the count, forms could point at each other")
    folder = scratch_path(vocabulary.sparkSession, "variants")
    vocabulary.write.parquet(os.path.join(folder, "words"))
    words = vocabulary.sparkSession.read.parquet(os.path.join(folder, "words"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    told = words.join(best, "word", "left").withColumn("is_form", -F.col("best.less") >= times * F.col("n"))
    told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"),
        F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
    ).write.parquet(os.path.join(folder, "forms"))
    forms = words.sparkSession.read.parquet(os.path.join(folder, "forms"))
    ends = _roots(forms.where("form IS NOT NULL"), folder)
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, least_chars: int = 5, least_count: int = 3, damage: int | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``group_variants`` of the words (``count_words``) of all whole texts.

    Null and empty texts have no words; repeated rows count each time; an empty table gives no rows; other columns are ignored,
    whatever their names; a run of any length is one word.
    """
    return group_variants(count_words(docs, least_chars, least_count, damage, id_column, text_column))
