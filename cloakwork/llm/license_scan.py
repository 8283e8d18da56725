"""Licence scans by a positional index of rare words, in Spark expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence wording. ``phrases`` must stand in it word for word; of the other words, ``share`` of all must fit."""

    label: str
    words: str
    phrases: tuple[str, ...]
    base: bool = False
    share: float = 0.8

    @property
    def tokens(self) -> list[str]:
        return self.words.split()

    @property
    def needed(self) -> list[int]:
        """Positions of the words of the mandatory phrases."""
        tokens, out = self.tokens, set()
        for phrase in self.phrases:
            want = phrase.split()
            at = next(i for i in range(len(tokens)) if tokens[i : i + len(want)] == want)
            out.update(range(at, at + len(want)))
        return sorted(out)


def phrase(label: str, words: str) -> Template:
    """A wording of which every word is mandatory."""
    return Template(label, words, (words,), base=True)


BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
WORDINGS = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("mit", "released under the mit license", ("mit license",), share=0.6),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("cc0-1.0", "creative commons cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)


def scan_words(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null is empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def rarity(docs: DataFrame, templates: tuple[Template, ...], text_column: str = "text") -> dict[str, float]:
    """IDF of each word that a mandatory phrase holds, counted over all documents; the result has one row per such word."""
    vocabulary = sorted({t.tokens[i] for t in templates for i in t.needed})
    found = F.array_intersect(scan_words(F.col(text_column)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}  # the empty word counts the documents
    return {w: math.log((1 + seen.get("", 0)) / (1 + seen.get(w, 0))) for w in vocabulary}


def anchors(template: Template, idf: dict[str, float], most: int = 2) -> list[int]:
    """Places of the rarest words among the mandatory ones."""
    tokens = template.tokens
    return sorted(template.needed, key=lambda i: (-idf[tokens[i]], i))[:most]


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = BASE + WORDINGS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_column, n_words, matches array<struct<label,base,start,score>>``.

    The index maps the rarest mandatory words of each wording (by IDF over all documents) to (wording, place). A text's
    words are looked up in it; each hit says where the wording would start, and a start counts only if every anchor of the
    wording says the same. Then the mandatory phrases are verified word by word at that start, and the share of fitting words
    is the score. A wording may begin before the text, as "The MIT License" at its very start: words in front of the text don't
    fit, and the start counts as 0. As all anchors are mandatory words, no wording that verifies is missed, whatever the IDF is.
    Null and empty texts have no words and no matches; repeated rows and null ids are scanned like others; an empty table
    gives no rows; other columns are ignored, whatever their names. One whole text is in memory at a time; nothing is shuffled.
    """
    idf = rarity(docs, templates, text_column)
    chosen = [anchors(t, idf) for t in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, (template, places) in enumerate(zip(templates, chosen)):
        for place in places:
            postings.setdefault(template.tokens[place], []).append((number, place))
    index = F.create_map(
        *[x for word, list_ in postings.items() for x in (F.lit(word), F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in list_]))]
    )
    catalogue = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.tokens)).alias("words"),
                F.array(*map(F.lit, t.needed)).alias("needed"), F.lit(len(c)).alias("anchors"), F.lit(t.share).alias("share"),
            )
            for t, c in zip(templates, chosen)
        ]
    )
    rare = sorted(postings)
    rows = docs.select(F.col(id_column), scan_words(F.col(text_column)).alias("_words"))
    hits = F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(rare), i)))
    rows = rows.withColumn("_hits", hits).withColumn("_index", F.when(F.size("_hits") > 0, index))
    proposals = F.flatten(
        F.transform(
            "_hits",
            lambda i: F.transform(
                F.element_at("_index", F.get("_words", i)), lambda e: F.struct(e["n"].alias("n"), (i - e["p"]).alias("start"))
            ),
        )
    )
    rows = rows.withColumn("_proposed", F.array_sort(proposals))
    rows = rows.withColumn("_catalogue", F.when(F.size("_proposed") > 0, catalogue))
    # equal proposals stand together: the anchors of a wording agree where the first of a run has as many behind it
    agreed = F.filter(
        F.transform(
            "_proposed",
            lambda p, i: F.when(
                (F.coalesce(F.get("_proposed", i - 1) != p, F.lit(True)))
                & (F.get("_proposed", i + F.get("_catalogue", p["n"])["anchors"] - 1) == p),
                p,
            ),
        ),
        lambda p: p.isNotNull(),
    )
    rows = rows.withColumn("_agreed", agreed)
    at = lambda p, j: F.coalesce(F.get("_words", p["start"] + j) == F.get(F.get("_catalogue", p["n"])["words"], j), F.lit(False))
    verified = F.filter("_agreed", lambda p: F.forall(F.get("_catalogue", p["n"])["needed"], lambda j: at(p, j)))
    scored = F.transform(
        verified,
        lambda p: F.struct(
            F.get("_catalogue", p["n"])["label"].alias("label"), F.get("_catalogue", p["n"])["base"].alias("base"),
            F.greatest(p["start"], F.lit(0)).cast("long").alias("start"),
            (
                F.size(F.filter(F.sequence(F.lit(0), F.size(F.get("_catalogue", p["n"])["words"]) - 1), lambda j: at(p, j)))
                / F.size(F.get("_catalogue", p["n"])["words"])
            ).alias("score"),
            F.get("_catalogue", p["n"])["share"].alias("share"),
        ),
    )
    kept = F.transform(
        F.filter(scored, lambda m: m["score"] >= m["share"]),
        lambda m: F.struct(m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), m["score"].alias("score")),
    )
    return rows.select(id_column, F.size("_words").cast("long").alias("n_words"), F.coalesce(kept, F.array().cast("array<struct<label:string,base:boolean,start:long,score:double>>")).alias("matches"))


def brute_force_sql(templates: tuple[Template, ...] = BASE + WORDINGS, table: str = "documents") -> str:
    """The same rows in SQL: every wording laid at every place of every text (no index, no anchors)."""
    words = ", ".join(f"({n}, {i}, '{w}', {i in t.needed})" for n, t in enumerate(templates) for i, w in enumerate(t.tokens))
    heads = ", ".join(f"({n}, '{t.label}', {t.base}, {len(t.tokens)}, {len(t.needed)}, {t.share})" for n, t in enumerate(templates))
    return rf"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM {table}
), words AS (SELECT doc_id, unnest(range(len(words))) AS place, unnest(words) AS word FROM texts),
wording(n, i, word, needed) AS (VALUES {words}), head(n, label, base, size, needed, share) AS (VALUES {heads}),
laid AS (
  SELECT doc_id, n, place - i AS start, count(*) AS fits, count(*) FILTER (wording.needed) AS good
  FROM words JOIN wording USING (word) GROUP BY ALL
), matches AS (
  SELECT doc_id, label, base, greatest(start, 0) AS start, fits / size AS score FROM laid JOIN head USING (n) WHERE good = head.needed AND fits / size >= share
), summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM matches GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN summed USING (doc_id)
"""
