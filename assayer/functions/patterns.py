"""Target patterns: words, `stem*`, phrases, `&`, `|` and parentheses over whole words.

A pattern is compiled where its row is, in Arrow batches over the table of targets, into
the phrases it names and a postfix program over them. Matching is then a column expression
on the text's row: no token rows, no shuffle, and no bound on a pattern's size.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, words_line, words_lines

COMPILED = T.StructType(
    [
        T.StructField("phrases", T.ArrayType(T.StringType())),
        T.StructField("program", T.ArrayType(T.IntegerType())),
        T.StructField("problem", T.StringType()),
    ]
)
ALL, ANY = -1, -2
NOWHERE = 2147483647
STEM = "[^ ]*"

# A pattern's symbols.
_SYMBOL = re.compile(r"[()&|]|[^\s()&|]+")
_BINDING = {"|": (1, ANY), "&": (2, ALL)}


class Unreadable(ValueError):
    pass


def _phrase_regex(atoms: list[str]) -> str:
    """The phrase as a regex over a words line. Words hold no regex symbols."""
    found: list[tuple[str, bool]] = []
    for atom in atoms:
        words = re.findall(r"\w+", atom)
        if not words:
            raise Unreadable(f"{atom!r} names no word")
        found += [(w.casefold(), atom.endswith("*") and w is words[-1]) for w in words[:-1]]
        found.append((words[-1].casefold(), atom.endswith("*")))
    regex = "".join(f" {word}{STEM}" if stem else f" {word}" for word, stem in found)
    # A final stem needs no tail: its prefix decides.
    return regex[: -len(STEM)] if found[-1][1] else regex + " "


def read_pattern(text: str) -> tuple[list[str], list[int]]:
    """Shunting-yard over the symbols: phrases are operands, `&` binds tighter than `|`."""
    phrases: list[str] = []
    program: list[int] = []
    pending: list[str] = []
    atoms: list[str] = []
    symbols = _SYMBOL.findall(text)
    if not symbols:
        raise Unreadable("a pattern names at least one word")
    wants_operand = True

    def unwind(to: int) -> None:
        while pending and pending[-1] != "(" and _BINDING[pending[-1]][0] >= to:
            program.append(_BINDING[pending.pop()][1])

    def close_phrase() -> None:
        if atoms:
            regex = _phrase_regex(atoms)
            if regex not in phrases:
                phrases.append(regex)
            program.append(phrases.index(regex))
            atoms.clear()

    for symbol in symbols:
        if symbol not in ("(", ")", "&", "|"):
            if not wants_operand and not atoms:
                raise Unreadable(f"unexpected {symbol!r} in {text!r}")
            atoms.append(symbol)
            wants_operand = False
            continue
        if symbol == "(":
            if not wants_operand:
                never = "(" in pending
                raise Unreadable(
                    f"a '(' in {text!r} is never closed" if never else f"unexpected '(' in {text!r}"
                )
            pending.append(symbol)
            continue
        if wants_operand:
            raise Unreadable(f"a word is missing in {text!r}")
        close_phrase()
        if symbol == ")":
            unwind(0)
            if not pending:
                raise Unreadable(f"unexpected ')' in {text!r}")
            pending.pop()
        else:
            unwind(_BINDING[symbol][0])
            pending.append(symbol)
            wants_operand = True
    if wants_operand:
        raise Unreadable(f"a word is missing in {text!r}")
    close_phrase()
    unwind(0)
    if pending:
        raise Unreadable(f"a '(' in {text!r} is never closed")
    return phrases, program


@F.pandas_udf(COMPILED)
def compile_pattern(patterns: pd.Series) -> pd.DataFrame:
    read: dict[str | None, tuple] = {None: (None, None, None)}
    for text in patterns.unique():
        if text is not None:
            try:
                read[text] = (*read_pattern(text), None)
            except Unreadable as e:
                read[text] = (None, None, str(e))
    return pd.DataFrame([read[text] for text in patterns], columns=["phrases", "program", "problem"])


def with_compiled(targets: DataFrame, pattern: str = "pattern", into: str = "compiled") -> DataFrame:
    """Targets with their patterns compiled, each distinct pattern read once per batch of targets."""
    return targets.withColumn(into, compile_pattern(F.col(pattern)))


def phrase_at(line: Column, phrase: Column) -> Column:
    """Where in a words line a phrase first starts (from 1), or NOWHERE.

    A phrase without a stem inside is found as plain text, which needs no regex.
    """
    with_stem = let(
        F.split(line, phrase, 2),
        lambda parts: F.when(F.size(parts) > 1, F.length(F.element_at(parts, 1)) + 1).otherwise(F.lit(NOWHERE)),
    )
    plain = let(F.instr(line, phrase), lambda at: F.when(at > 0, at).otherwise(F.lit(NOWHERE)))
    return F.when(F.contains(phrase, F.lit(STEM)), with_stem).otherwise(plain)


def find(line: Column, compiled: Column) -> Column:
    """Where in a words line what satisfies a compiled pattern first starts, or NOWHERE.

    `&` is nowhere unless both sides are somewhere; both operators take the earlier side.
    """

    def step(stack: Column, op: Column) -> Column:
        depth = F.size(stack)
        a, b = F.get(stack, depth - 1), F.get(stack, depth - 2)
        joined = F.when(
            (op == ALL) & ((a == NOWHERE) | (b == NOWHERE)), F.lit(NOWHERE)
        ).otherwise(F.least(a, b))
        return F.when(
            op >= 0, F.concat(stack, F.array(phrase_at(line, F.get(compiled["phrases"], op))))
        ).otherwise(F.concat(F.slice(stack, 1, depth - 2), F.array(joined)))

    return F.aggregate(
        compiled["program"], F.array().cast("array<int>"), step, lambda stack: F.get(stack, F.lit(0))
    )


def word_number(line: Column, at: Column) -> Column:
    """The number (from 0) of the word at a place in a words line: the spaces before it."""
    head = F.substr(line, F.lit(1), at - 1)
    return F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))


def find_word(line: Column, compiled: Column) -> Column:
    """The number of the earliest word satisfying a compiled pattern, or NOWHERE."""
    return let(
        find(line, compiled),
        lambda at: F.when(at == NOWHERE, F.lit(NOWHERE)).otherwise(word_number(line, at)),
    )


def matches(text: Column, compiled: Column) -> Column:
    return let(words_line(text), lambda line: find(line, compiled)) != NOWHERE


def hits(texts: Column, compiled: Column) -> Column:
    """Whether the pattern is in each text of an array."""
    return F.transform(words_lines(texts), lambda line: find(line, compiled) != NOWHERE)
