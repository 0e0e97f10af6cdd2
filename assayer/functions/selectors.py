"""JSON Pointer and a JSONPath subset, compiled to column expressions over VARIANT."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tape

MISSING = object()


@dataclass(frozen=True)
class Step:
    """kind: name, index, token, wild or filter."""

    kind: str
    value: Any = None
    path: tuple["Step", ...] = ()
    op: str | None = None


# The subset's grammar, one alternative per segment.
_NAME = r"[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff]*"
_STRING = r"'(?:[^'\\\x00-\x1f]|\\.)*'|\"(?:[^\"\\\x00-\x1f]|\\.)*\""
_INT = r"0|-?[1-9][0-9]*"
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_BLANK = r"[ \t\n\r]*"
_MEMBER = rf"\.(?P<name>{_NAME})|\[{_BLANK}(?:(?P<quoted>{_STRING})|(?P<index>{_INT})){_BLANK}\]"
_RELATIVE = re.compile(_MEMBER)
_SEGMENT = re.compile(
    rf"{_MEMBER}|(?P<wild>\.\*|\[{_BLANK}\*{_BLANK}\])|(?P<filter>\[{_BLANK}\?{_BLANK}@)"
)
_TEST_END = re.compile(
    rf"{_BLANK}(?:(?P<op>==|!=){_BLANK}(?P<lit>true|false|null|{_STRING}|{_NUMBER}))?{_BLANK}\]"
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}(?:\\u[dD][c-fC-F][0-9A-Fa-f]{2})?|.)", re.DOTALL)
_PLAIN_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "/": "/", "\\": "\\", "'": "'", '"': '"'}


def _unquote(literal: str, selector: str) -> str:
    def one(m: re.Match[str]) -> str:
        body = m.group(1)
        if body in _PLAIN_ESCAPES:
            return _PLAIN_ESCAPES[body]
        if not body.startswith("u") or len(body) < 5:
            raise ValueError(f"{selector!r}: an unknown escape \\{body}")
        units = [int(u, 16) for u in re.findall(r"u([0-9A-Fa-f]{4})", body)]
        if len(units) == 2 and not 0xD800 <= units[0] < 0xDC00:
            return chr(units[0]) + chr(units[1])
        return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "surrogatepass")

    return _ESCAPE.sub(one, literal[1:-1])


def _member(m: re.Match[str], selector: str) -> Step:
    if m.group("name") is not None:
        return Step("name", m.group("name"))
    if m.group("quoted") is not None:
        return Step("name", _unquote(m.group("quoted"), selector))
    return Step("index", int(m.group("index")))


def _literal(text: str, selector: str) -> Any:
    words = {"true": True, "false": False, "null": None}
    if text in words:
        return words[text]
    if text[0] in "'\"":
        return _unquote(text, selector)
    return int(text) if re.fullmatch(r"-?[0-9]+", text) else float(text)


@lru_cache(maxsize=1024)
def parse(selector: str) -> tuple[Step, ...]:
    if selector == "" or selector.startswith("/"):
        if re.search(r"~(?![01])", selector):
            raise ValueError(f"{selector!r}: ~ must be followed by 0 or 1")
        tokens = selector.split("/")[1:]
        return tuple(Step("token", t.replace("~1", "/").replace("~0", "~")) for t in tokens)
    if not selector.startswith("$"):
        raise ValueError(f"{selector!r} is neither a JSON Pointer nor a JSONPath query")
    steps: list[Step] = []
    at = 1
    while at < len(selector):
        m = _SEGMENT.match(selector, at)
        if m is None:
            raise ValueError(f"{selector!r}: outside the subset at position {at}")
        at = m.end()
        if m.group("wild"):
            steps.append(Step("wild"))
        elif m.group("filter"):
            path: list[Step] = []
            while (r := _RELATIVE.match(selector, at)) is not None:
                path.append(_member(r, selector))
                at = r.end()
            end = _TEST_END.match(selector, at)
            if end is None:
                raise ValueError(f"{selector!r}: outside the subset at position {at}")
            at = end.end()
            lit = MISSING if end.group("op") is None else _literal(end.group("lit"), selector)
            steps.append(Step("filter", lit, tuple(path), end.group("op")))
        else:
            steps.append(_member(m, selector))
    return tuple(steps)


def _as_array(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _as_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def _name(v: Column, name: str) -> Column:
    for quote in "'\"":
        if quote not in name and "\\" not in name:
            return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")
    return F.try_element_at(_as_object(v), F.lit(name))


def _one(v: Column, step: Step) -> Column:
    """The single node a member or index step picks; SQL null when there is none."""
    if step.kind == "name":
        return _name(v, step.value)
    if step.kind == "index":
        position = step.value + 1 if step.value >= 0 else step.value
        return F.try_element_at(_as_array(v), F.lit(position))
    if re.fullmatch(r"0|[1-9][0-9]*", step.value) and int(step.value) < 2**31 - 1:
        element = F.try_element_at(_as_array(v), F.lit(int(step.value) + 1))
        return F.coalesce(element, _name(v, step.value))
    return _name(v, step.value)


def equals(v: Column, literal: Any) -> Column:
    """JSON equality with a literal: no booleans as numbers, 1 as 1.0; null for a missing node."""
    kind = F.schema_of_variant(v)
    if literal is None:
        return F.is_variant_null(v)
    if isinstance(literal, bool):
        return (kind == "BOOLEAN") & (v.try_cast("boolean") == literal)
    if isinstance(literal, str):
        return (kind == "STRING") & (v.try_cast("string") == literal)
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return numeric & (v.try_cast("double") == float(literal))


def _passes(child: Column, step: Step) -> Column:
    node = child
    for s in step.path:
        node = _one(node, s)
    if step.op is None:
        return node.isNotNull()
    equal = F.coalesce(equals(node, step.value), F.lit(False)) & node.isNotNull()
    return equal if step.op == "==" else ~equal


def _test_of(step: Step) -> Callable[[Column], Column]:
    return lambda v: _passes(v, step)


def _pick_of(step: Step) -> Callable[[Column], Column]:
    return lambda v: _one(v, step)


def _children(v: Column, json: Column | None) -> Column:
    """An array's elements, or an object's values in the document's order.

    VARIANT sorts an object's keys, so where the node's text is at hand its keys give the
    order; deeper nodes, whose text is not, come in key order.
    """
    members = _as_object(v)
    if json is None:
        values = F.map_values(members)
    else:
        values = F.transform(F.json_object_keys(json), lambda k: F.element_at(members, k))
    return F.coalesce(_as_array(v), values, F.array().cast("array<variant>"))


def _json_path(steps: list[Step]) -> str | None:
    path = "$"
    for s in steps:
        if s.kind == "index" and s.value >= 0:
            path += f"[{s.value}]"
        elif s.kind in ("name", "token") and not re.search(r"['\\\]\[]", str(s.value)):
            path += f"['{s.value}']"
        else:
            return None
    return path


def select(document: Column, selector: str, json: Column | None = None) -> Column:
    """The values a selector picks from a VARIANT, in document order: array<variant>.

    `json` is the document's text; give it where a wildcard may meet an object, whose
    member order only the text holds. Below a first wildcard the values are read off the text.
    """
    steps = list(parse(selector))
    many = next((i for i, s in enumerate(steps) if s.kind in ("wild", "filter")), len(steps))
    if json is not None and any(s.kind in ("wild", "filter") for s in steps[many + 1 :]):
        found = F.transform(tape.picks(json, selector), F.parse_json)
        return F.when(document.isNotNull(), F.coalesce(found, F.array().cast("array<variant>")))
    node = document
    for s in steps[:many]:
        node = _one(node, s)
    if many == len(steps):
        return F.when(node.isNull(), F.array().cast("array<variant>")).otherwise(F.array(node))
    path = _json_path(steps[:many])
    text = None if json is None or path is None else F.get_json_object(json, path) if path != "$" else json
    if node is document:
        nodes = _children(node, text)
    else:
        nodes = F.when(node.isNull(), F.array().cast("array<variant>")).otherwise(
            _children(node, text)
        )
    nodes = _filtered(nodes, steps[many])
    for s in steps[many + 1 :]:
        if s.kind in ("wild", "filter"):
            nodes = _filtered(F.flatten(F.transform(nodes, lambda v: _children(v, None))), s)
        else:
            nodes = F.filter(F.transform(nodes, _pick_of(s)), lambda v: v.isNotNull())
    return nodes


def _filtered(nodes: Column, step: Step) -> Column:
    return F.filter(nodes, _test_of(step)) if step.kind == "filter" else nodes
