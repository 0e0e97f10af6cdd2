"""JSON documents as they are written: where each value stands in the text, beside what VARIANT says it is.

VARIANT sorts an object's members and spells numbers its own way. Where order or spelling counts (members below
wildcards, items written out, messages sent back), values are taken from the document's text: a value's children are
read off as stretches of the text, and only those on a selector's way are looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[int, int]
_SPACE = json.decoder.WHITESPACE.match
_GAP = re.compile(r"\s")
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)


def _value(text: str, at: int) -> tuple[Any, int]:
    """A value and where it ends. The decoder is the module's own: one of ours couldn't travel with tasks."""
    return json._default_decoder.raw_decode(text, at)


def children(text: str, span: Span) -> Iterator[tuple[str | int, Span]]:
    """An array's elements by place or an object's members by name, in order of the text."""
    opened = text[span[0]]
    if opened not in "[{":
        return
    at, place = _SPACE(text, span[0] + 1).end(), 0
    while text[at] not in "]}":
        name: str | int = place
        if opened == "{":
            name, at = json.decoder.scanstring(text, at + 1)
            at = _SPACE(text, _SPACE(text, at).end() + 1).end()
        _, end = _value(text, at)
        yield name, (at, end)
        place += 1
        at = _SPACE(text, end).end()
        if text[at] == ",":
            at = _SPACE(text, at + 1).end()


def _step(text: str, span: Span, step: Any) -> Span | None:
    """The child that a name, index or pointer token picks; the last of a name, as in a parsed document."""
    opened = text[span[0]]
    if step.kind == "index" or (step.kind == "token" and opened == "[" and re.fullmatch(r"0|[1-9][0-9]*", step.value)):
        found = [s for _, s in children(text, span)] if opened == "[" else []
        place = int(step.value)
        return found[place] if -len(found) <= place < len(found) else None
    if opened != "{":
        return None
    found = [s for name, s in children(text, span) if name == step.value]
    return found[-1] if found else None


def _passes(text: str, span: Span, step: Any) -> bool:
    node: Span | None = span
    for s in step.path:
        node = None if node is None else _step(text, node, s)
    if step.op is None:
        return node is not None
    equal = node is not None and _same(json.loads(text[node[0] : node[1]]), step.value)
    return equal if step.op == "==" else not equal


def _same(value: Any, literal: Any) -> bool:
    """JSON equality with a literal: no booleans as numbers, 1 as 1.0."""
    if literal is None or isinstance(literal, bool) or value is None or isinstance(value, bool):
        return value is literal
    return isinstance(value, str) == isinstance(literal, str) and not isinstance(value, (list, dict)) and value == literal


def _unique(text: str, span: Span) -> list[Span]:
    """The children a wildcard meets: of members with one name the last, at the place of the first."""
    return list(dict(children(text, span)).values())


def spans(text: str, steps: tuple) -> list[Span]:
    """Where the values stand that a parsed selector picks, in order; nothing where the text isn't JSON."""
    begin = _SPACE(text, 0).end()
    try:
        _, end = _value(text, begin)
    except ValueError:
        return []
    return below(text, [(begin, end)], steps)


def below(text: str, found: list[Span], steps: tuple) -> list[Span]:
    """Where the values stand that steps pick from some."""
    for step in steps:
        if step.kind in ("wild", "filter"):
            found = [child for span in found for child in _unique(text, span)]
            if step.kind == "filter":
                found = [span for span in found if _passes(text, span, step)]
        else:
            found = [child for span in found if (child := _step(text, span, step)) is not None]
    return found


def compact(text: str) -> str:
    """JSON without white space between its tokens, each as it is written."""
    return "".join(_TOKENS.findall(text)) if _GAP.search(text) else text


def pretty(text: str) -> str:
    """JSON indented by two, each token as it is written."""
    out, depth, tokens = [], 0, _TOKENS.findall(text)
    for i, token in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if token in "[{":
            empty = after in ("]", "}")
            depth += not empty
            out.append(token if empty else token + "\n" + "  " * depth)
        elif token in "]}":
            if tokens[i - 1] not in ("[", "{"):
                depth -= 1
                out.append("\n" + "  " * depth)
            out.append(token)
        else:
            out.append(",\n" + "  " * depth if token == "," else ": " if token == ":" else token)
    return "".join(out)


def picks(text: Column, selector: str) -> Column:
    """What a selector picks from a document's text, each value as it is written: array<string>, null for a null text."""
    from .selectors import parse

    steps = parse(selector)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def picked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [compact(t[a:b]) for a, b in spans(t, steps)])

    return picked(text)


def members(text: Column, selector: str, names: list[str]) -> Column:
    """Of what a selector picks first, these members as they are written: array<string>, in the names' order.

    The text is read once for all of them. A member that isn't there is null; null for a null text.
    """
    from .selectors import parse

    steps = parse(selector)

    def of(t: str | None) -> list[str | None] | None:
        if t is None:
            return None
        found = spans(t, steps)[:1]
        own = dict(children(t, found[0])) if found and t[found[0][0]] == "{" else {}
        return [compact(t[own[n][0] : own[n][1]]) if n in own else None for n in names]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def picked(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return picked(text)
