"""Chat formatting in Spark expressions: sorted turns, merged neighbours of one role, a loss mask, and reading it back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around blocks of turns. ``guarded`` strings mean something to a model and are escaped inside texts as well.

    A block is ``begin role body text (next text)* end``; ``next`` parts turns of one role that stand together. An escape puts
    one backslash behind the first character of a guarded string; the backslashes that such a string already has are counted
    in, so unescaping takes exactly one away again.
    """

    begin: str = "<|im_start|>"
    body: str = "<|im_body|>"
    next: str = "<|im_next|>"
    end: str = "<|im_end|>"
    guarded: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        strings = self.strings
        if len(set(strings)) < len(strings) or any(len(s) < 2 or "\\" in s for s in strings):
            raise ValueError("marks must differ, have two characters or more and no backslash")
        if any(s[0] in t[1:] for s in strings for t in strings):
            raise ValueError("no mark may hold the first character of a mark further in")

    @property
    def strings(self) -> tuple[str, ...]:
        return (self.begin, self.body, self.next, self.end, *self.guarded)

    def escape(self, text: Column) -> Column:
        for first, rest in self._by_first():
            text = F.regexp_replace(text, rf"({re.escape(first)})(\\*)({rest})", r"$1\\$2$3")
        return text

    def unescape(self, text: Column) -> Column:
        for first, rest in self._by_first():
            text = F.regexp_replace(text, rf"({re.escape(first)})\\(\\*)({rest})", "$1$2$3")
        return text

    def _by_first(self) -> list[tuple[str, str]]:
        firsts = sorted({s[0] for s in self.strings})
        return [(f, "|".join(re.escape(s[1:]) for s in self.strings if s[0] == f)) for f in firsts]


def format_chats(
    turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """``conv_column, formatted, loss_spans array<struct<start,length>>, n_blocks`` of each conversation.

    Turns are collected as structs, sorted by turn (then role and text, so ties and repeated rows have one order; null turns
    first), cut into blocks of one role, and joined. Spans count code points of ``formatted`` from 1 and cover each trained
    text without its marks. Null texts and roles are empty; rows without conversation id form one conversation of their own;
    an empty table gives none; other columns are ignored, whatever their names. A conversation is one row, so it is in memory
    at once; nothing else is collected.
    """
    role, text = F.coalesce(F.col(role_column).cast("string"), F.lit("")), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    turn = F.struct(
        F.col(turn_column).alias("turn"), role.alias("role"), text.alias("raw"),
        template.escape(role).alias("name"), template.escape(text).alias("text"),
    )
    chats = turns.groupBy(F.col(conv_column).alias("_conv")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    at = lambda i: F.get("_turns", i)
    last = F.size("_turns") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    chats = chats.withColumn("_starts", starts)
    # a block: its mark with the role, then the texts of its turns
    block = lambda first, k: F.struct(
        F.concat(F.lit(template.begin), at(first)["name"], F.lit(template.body)).alias("head"),
        F.transform(
            F.slice("_turns", first + 1, F.coalesce(F.get("_starts", k + 1), F.size("_turns")) - first), lambda t: t["text"]
        ).alias("texts"),
        at(first)["role"].isin(*template.trained).alias("trained"),
    )
    chats = chats.withColumn("_blocks", F.transform("_starts", block))
    merged = F.transform("_blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], template.next), F.lit(template.end)))
    # walk over the turns with the place behind what is written so far, and note where trained texts stand
    pieces = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(b["head"])).otherwise(len(template.next)).alias("before"),
                    F.length(t).alias("length"),
                    F.when(i == F.size(b["texts"]) - 1, len(template.end)).otherwise(0).alias("behind"),
                    b["trained"].alias("trained"),
                ),
            ),
        )
    )
    span = lambda start, length: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))
    walk = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("place"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["place"] + p["before"] + p["length"] + p["behind"]).alias("place"),
            F.when(p["trained"], F.concat(s["spans"], F.array(span(s["place"] + p["before"], p["length"]))))
            .otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return chats.select(
        F.col("_conv").alias(conv_column), F.array_join(merged, "").alias("formatted"), walk.alias("loss_spans"),
        F.size("_blocks").cast("long").alias("n_blocks"),
    )


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Turns of a formatted conversation, as array<struct<role,text>>, unescaped."""
    blocks = F.filter(F.split(formatted, re.escape(template.end)), lambda b: b != "")
    turns = lambda b: F.transform(
        F.split(F.substring_index(b, template.body, -1), re.escape(template.next)),
        lambda t: F.struct(
            template.unescape(F.substr(F.substring_index(b, template.body, 1), F.lit(len(template.begin) + 1))).alias("role"),
            template.unescape(t).alias("text"),
        ),
    )
    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substr(formatted, s["start"], s["length"]))), "")
