"""JSON as text: where key order and spelling matter, VARIANT cannot be used."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tape import pretty

_TOKENS = r'"(?:[^"\\]|\\.)*+"|[,:]|[^",:]+'


def spaced(compact: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside strings."""
    tokens = F.regexp_extract_all(compact, F.lit(_TOKENS), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)),
        "",
    )


@F.pandas_udf(T.StringType())
def sorted_top_level(bodies: pd.Series) -> pd.Series:
    """Compact JSON with only the top-level keys sorted, which no built-in expresses."""

    def one(text):
        if text is None:
            return None
        doc = json.loads(text)
        return json.dumps(
            {k: doc[k] for k in sorted(doc)}, separators=(",", ":"), ensure_ascii=False
        )

    return bodies.map(one)


@F.pandas_udf(T.StringType())
def indented(values: pd.Series) -> pd.Series:
    """JSON indented by two, as a judge reads it, each token as it is written."""
    return values.map(lambda v: None if v is None else pretty(v))


# Control characters whose escapes have a letter, which Spark writes in capitals.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def lowered(json_text: Column) -> Column:
    """JSON as Spark writes it with its control characters' escapes in lower case, as other writers have them.

    An escape begins at a backslash that isn't itself escaped.
    """
    found = json_text
    for digits in _LETTERED:
        found = F.regexp_replace(found, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(json_text.contains("\\u00"), found).otherwise(json_text)


def members(text: str) -> dict[str, str]:
    """An object's members as they are written, the last of a name; nothing where the text is no object."""
    space, string, value = json.decoder.WHITESPACE.match, json.decoder.scanstring, json.JSONDecoder().raw_decode
    found: dict[str, str] = {}
    at = space(text, 0).end()
    if text[at : at + 1] != "{":
        return found
    at = space(text, at + 1).end()
    while text[at : at + 1] == '"':
        name, at = string(text, at + 1)
        begin = space(text, space(text, at).end() + 1).end()
        _, end = value(text, begin)
        found[name] = text[begin:end]
        at = space(text, end).end()
        if text[at : at + 1] != ",":
            break
        at = space(text, at + 1).end()
    return found


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(lowered(F.to_json(F.struct(text.alias("s")))), r'(?s)^\{"s":(.*)\}$', 1))
