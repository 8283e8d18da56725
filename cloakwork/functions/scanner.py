"""Leaves of JSON, XML and HTML texts with their paths: one linear scan with a stack of open containers.

The scan runs in Arrow batches, because column expressions have no running state over an array that isn't copied at each step;
what happens to the leaves is column expressions again. Paths are ``$.a[].b`` in JSON, ``$.a.b`` and ``$.a.b@attribute`` in XML,
and the name of the element around the text in HTML.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import let

Piece = tuple[str | None, str, str | None]  # path of a leaf, the text as written, the text it stands for

JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^"{}\[\]:,]+|"', re.S)
MARKUP_TOKEN = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|</?[A-Za-z_:](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(\s*=\s*)(\"[^\"]*\"|'[^']*')")
TAG_NAME = re.compile(r"</?([^\s/>]+)")
XML_ENTITY = re.compile("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|amp|lt|gt|quot|apos);")
# HTML elements that have no end tag, and those whose content is no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CODE = {"script", "style"}


def json_pieces(text: str) -> Iterator[Piece]:
    """Every string value is a leaf; keys, numbers and marks are not. A text that is no JSON gives its strings all the same."""
    stack: list[list] = []  # [path, is an object, key of the value to come or None]

    def place() -> str:
        if not stack:
            return "$"
        path, is_object, key = stack[-1]
        return f"{path}.{key}" if is_object else f"{path}[]"

    for token in JSON_TOKEN.findall(text):
        first = token[0]
        if first == '"' and len(token) > 1:
            if stack and stack[-1][1] and stack[-1][2] is None:
                stack[-1][2] = _json_text(token) or ""
                yield None, token, None
            else:
                yield place(), token, _json_text(token)
            continue
        if first in "{[":
            stack.append([place(), first == "{", None])
        elif first in "}]" and stack:
            stack.pop()
        elif first == "," and stack:
            stack[-1][2] = None
        yield None, token, None


def _json_text(token: str) -> str | None:
    try:
        plain = json.loads(token, strict=False)
        plain.encode()  # half of a surrogate pair is no text
        return plain
    except ValueError:
        return None


def _xml_text(text: str) -> str:
    return XML_ENTITY.sub(lambda m: unescape(m[0]), text) if "&" in text else text


def xml_pieces(text: str) -> Iterator[Piece]:
    """Text between tags, character data sections and attribute values are leaves."""
    stack = ["$"]
    for token in MARKUP_TOKEN.findall(text):
        if not token.startswith("<") or token == "<":
            yield stack[-1], token, _xml_text(token)
        elif token.startswith("<![CDATA["):
            yield stack[-1], token, token[9:-3]
        elif token.startswith("</"):
            if len(stack) > 1:
                stack.pop()
            yield None, token, None
        elif token[1] in "!?":
            yield None, token, None
        else:
            path = f"{stack[-1]}.{TAG_NAME.match(token)[1]}"
            at = 0
            for m in ATTRIBUTE.finditer(token, len(TAG_NAME.match(token)[0])):
                yield None, token[at : m.start(3) + 1], None
                yield f"{path}@{m[1]}", m[3][1:-1], _xml_text(m[3][1:-1])
                at = m.end(3) - 1
            yield None, token[at:], None
            if not token.endswith("/>"):
                stack.append(path)


def html_pieces(text: str) -> Iterator[Piece]:
    """Text nodes are leaves, under the name of the element around them; scripts and styles are not."""
    stack, low, at = [], text.lower(), 0
    while at < len(text):
        token = MARKUP_TOKEN.match(text, at)[0]
        at += len(token)
        if not token.startswith("<") or token == "<":
            yield (stack[-1] if stack else "body"), token, unescape(token)
            continue
        yield None, token, None
        if token[1] in "!?" or not (name := TAG_NAME.match(token)):
            continue
        tag = name[1].lower()
        if token.startswith("</"):
            if tag in stack:
                while stack.pop() != tag:
                    pass
        elif tag in CODE:
            end = low.find(f"</{tag}", at)
            end = len(text) if end < 0 else end
            if end > at:
                yield None, text[at:end], None
            at = end
        elif tag not in VOID and not token.endswith("/>"):
            stack.append(tag)


FORMS = {"json": json_pieces, "xml": xml_pieces, "html": html_pieces}


def pieces(value: Column, form: str) -> Column:
    """Array of ``path, raw, plain``: the raw texts in a row are the value; ``plain`` is set on leaves only. Null gives null."""
    scan = FORMS[form]

    @F.pandas_udf("array<struct<path:string,raw:string,plain:string>>")
    def scanned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(("path", "raw", "plain"), p)) for p in scan(t)] for t in texts], dtype=object)

    return scanned(value)


def leaves(value: Column, form: str) -> Column:
    """Array of (path, text) of the leaves."""
    found = F.filter(pieces(value, form), lambda p: p["plain"].isNotNull())
    return F.transform(found, lambda p: F.struct(p["path"].alias("path"), p["plain"].alias("text")))


def selects(selector: str | None, path: Column) -> Column:
    """Whether a rule's selector, a part of the path in any case, is for a leaf; no selector is for all."""
    wanted = (selector or "").strip().lower()
    return F.lower(path).contains(wanted) if wanted else F.lit(True)


LeafChange = Callable[[Column, Column], Column]  # (plain text, path) -> new text


def _written(new: Column, form: str) -> Column:
    from cloakwork.functions.structured import encoded

    if form == "json":
        return F.regexp_extract(F.to_json(F.struct(new.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return encoded(new)


def change_leaves(value: Column, form: str, change: LeafChange) -> Column:
    """The text with its leaves changed; a leaf that doesn't change keeps its own writing, and so does all else."""

    def one(p: Column) -> Column:
        new = let(change(p["plain"], p["path"]), lambda n: F.when(n.eqNullSafe(p["plain"]), p["raw"]).otherwise(_written(n, form)))
        return F.when(p["plain"].isNull(), p["raw"]).otherwise(F.coalesce(new, p["raw"]))

    return F.array_join(F.transform(pieces(value, form), one), "")


def change_selected(value: Column, form: str, changes: Sequence[tuple[str | None, Callable[[Column], Column]]]) -> Column:
    """Each change in turn on the leaves its selector names."""

    def all_in_turn(text: Column, path: Column, rest: Sequence) -> Column:
        if not rest:
            return text
        (selector, change), *more = rest
        return let(F.when(selects(selector, path), change(text)).otherwise(text), lambda t: all_in_turn(t, path, more))

    return change_leaves(value, form, lambda text, path: all_in_turn(text, path, list(changes)))
