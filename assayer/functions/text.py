"""Text operations as column expressions, each named and versioned where its behaviour is pinned."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python treats as whitespace, as a regex class body.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
# Fixed value: the line boundaries of Python's str.splitlines.
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e" + chr(0x85) + chr(0x2028) + chr(0x2029)
# Fixed value: the characters of a word.
WORD = r"\p{L}\p{N}_"
# Fixed value: the list markers dropped from the start of a line.
LIST_MARKER = rf"^[{SPACE}]*(?:[-*•]|\p{{Nd}}+[.)])[{SPACE}]+"
# Fixed value: what parts one text unit from the next.
UNIT_GAP = rf"\n+|(?<=[.!?])[{SPACE}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _folds() -> tuple[str, str, dict[str, str]]:
    """Where full case folding differs from lower-casing, found by rule from the Unicode data."""
    single_from, single_to, many = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        # A letter that folds to another lower-case form than its own lower case; applied
        # after lower-casing, so only characters that are left by it matter.
        if c.lower() != c or (folded := c.casefold()) == c:
            continue
        if len(folded) == 1:
            single_from.append(c)
            single_to.append(folded)
        else:
            many[c] = folded
    return "".join(single_from), "".join(single_to), many


_SINGLE_FROM, _SINGLE_TO, _MANY = _folds()
_RARE = {c: f for c, f in _MANY.items() if c != "ß"}


def _ranges(chars: str, gap: int = 32) -> str:
    """A regex class body covering the characters, neighbours closer than the gap joined."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans)


_SPECIAL = "".join(_RARE) + _SINGLE_FROM
_SPECIAL_CHARACTER = f"[{_ranges(_SPECIAL)}]"
_LATIN_ONLY = r"^[\x00-\xb4\xb6-\xff]*+\z"


def fold(text: Column) -> Column:
    """Python's str.casefold, in the JVM.

    Lower-casing does almost all of it; the sharp s is common enough to be replaced always,
    and the remaining folds run only on the texts that may hold one of their characters.
    """
    entries = F.split(F.lit(",".join(c + folded for c, folded in _RARE.items())), ",")

    def folded(lowered: Column) -> Column:
        rare = F.aggregate(
            entries,
            F.translate(lowered, _SINGLE_FROM, _SINGLE_TO),
            lambda acc, e: F.replace(acc, F.substring(e, 1, 1), F.substring(e, 2, 9)),
        )
        return F.when(
            ~lowered.rlike(_LATIN_ONLY) & lowered.rlike(_SPECIAL_CHARACTER), rare
        ).otherwise(lowered)

    return let(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), folded)


def _words(text: Column, keep: str = "") -> Column:
    """The folded text with each run of other characters as one space.

    Plain ASCII, told by its length in bytes, takes the simpler of two equal ways.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.regexp_replace(F.lower(text), f"[^a-z0-9_{keep}]+", " ")).otherwise(
        F.regexp_replace(fold(text), f"[^{WORD}{keep}]+", " ")
    )


def words_line(text: Column) -> Column:
    """The text's folded words, one space around each: ' an acute mi '. Blank for no words."""
    return F.concat(F.lit(" "), F.ltrim(let(F.concat(text, F.lit(" ")), lambda t: _words(t))))


_MARK = "\x01"


def words_lines(texts: Column) -> Column:
    """The words line of each text of an array.

    The texts are joined by a mark, folded and cut as one, and parted again: three passes over
    the whole instead of three over each of many small texts.
    """

    def parted(joined: Column) -> Column:
        return F.transform(
            F.split(_words(joined, _MARK), _MARK),
            lambda line: F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(line), F.lit(" ")))),
        )

    # A mark in a text becomes another character that is in no word.
    def each(bound: Column) -> Column:
        joined = F.array_join(F.transform(bound, lambda t: F.replace(t, F.lit(_MARK), F.lit("-"))), _MARK)
        return F.when(F.size(bound) == 0, F.array().cast("array<string>")).otherwise(let(joined, parted))

    return let(texts, each)


def unit_texts(text: Column) -> Column:
    return F.split(text, UNIT_GAP)


def unit_start(text: Column, nth: Column) -> Column:
    """The code-point offset at which a text's nth unit (from 0) starts."""
    head = F.slice(unit_texts(text), F.lit(1), nth)
    gaps = F.slice(F.regexp_extract_all(text, F.lit(UNIT_GAP), F.lit(0)), F.lit(1), nth)
    return F.length(F.array_join(head, "")) + F.length(F.array_join(gaps, ""))


def lines(text: Column) -> Column:
    """`lines@1`: one item per non-blank line, list markers dropped."""
    # Splitting at a newline takes no regex; the rarer breaks are made newlines where there are any.
    rare = F.contains(text, F.lit(RARE_BREAKS[0]))
    for c in RARE_BREAKS[1:]:
        rare = rare | F.contains(text, F.lit(c))
    broken = F.when(rare, F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)
    found = F.transform(
        F.split(broken, "\n"), lambda line: strip(F.regexp_replace(line, LIST_MARKER, ""))
    )
    return F.filter(found, lambda line: line != "")


_BLOCK = 32


def _starts_of(lengths: Column) -> Column:
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")
        ),
        lambda acc: acc["starts"],
    )


def running_starts(lengths: Column, levels: int = 2) -> Column:
    """Where each piece of a partitioned text starts, from the pieces' lengths.

    Appending to an array copies it, so the sum runs over blocks of blocks and within each
    block: a text of n pieces costs about 16 n steps a level instead of n squared.
    """

    def placed(lengths: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK),
        )
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, n: a + n))
        bases = _starts_of(sums) if levels == 1 else running_starts(sums, levels - 1)
        return F.flatten(
            F.zip_with(
                blocks,
                bases,
                lambda block, base: F.transform(_starts_of(block), lambda at: at + base),
            )
        )

    return let(
        lengths,
        lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(placed(n)),
    )


def word_pieces(text: Column) -> Column:
    """The text cut into alternating runs of word and other characters."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[^{WORD}]+"), F.lit(0))


def word_offset(text: Column, nth: Column) -> Column:
    """The code-point offset of the nth word (from 0)."""

    def offset(pieces: Column) -> Column:
        leading = F.when(F.element_at(pieces, 1).rlike(rf"^[{WORD}]"), 0).otherwise(1)
        before = F.slice(pieces, 1, 2 * nth + leading)
        return F.length(F.array_join(before, ""))

    return let(word_pieces(text), offset)


def units(text: Column) -> Column:
    """A text's units with the code-point offset each starts at: array<struct<start,unit>>."""
    parts = F.split(text, UNIT_GAP)
    gaps = F.concat(F.regexp_extract_all(text, F.lit(UNIT_GAP), F.lit(0)), F.array(F.lit("")))
    lengths = F.zip_with(parts, gaps, lambda u, g: F.length(u) + F.length(g))
    return let(
        lengths,
        lambda n: F.zip_with(
            running_starts(n), parts, lambda at, u: F.struct(at.alias("start"), u.alias("unit"))
        ),
    )


def words_at(text: Column) -> Column:
    """The text's folded words with their code-point offsets: array<struct<start,word>>."""

    def placed(words: Column, gaps: Column) -> Column:
        """A word's start is that of the gap before it, and its length."""
        both = F.zip_with(gaps, words, lambda gap, w: F.length(gap) + F.length(w))
        starts = F.zip_with(running_starts(both), gaps, lambda at, gap: at + F.length(gap))
        # Whether folding is more than lower-casing is asked once per text, not per word.
        plain = F.lower(text).rlike(_LATIN_ONLY)
        simple = lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss"))
        folded = lambda make: F.zip_with(starts, words, lambda at, w: F.struct(at.alias("start"), make(w).alias("word")))
        return F.when(plain, folded(simple)).otherwise(folded(fold))

    gaps = F.split(text, f"[{WORD}]+", -1)
    words = F.regexp_extract_all(text, F.lit(f"[{WORD}]+"), F.lit(0))
    return let(words, lambda w: let(F.slice(gaps, 1, F.size(w)), lambda g: placed(w, g)))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


# Named, versioned cleanup operations: a name is never given another behaviour.
CLEANUP: dict[str, Callable[[Column], Column]] = {
    "newlines.lf@1": lambda t: F.regexp_replace(t, r"\r\n?", "\n"),
    "unicode.nfc@1": nfc,
    "strip@1": strip,
    "blank_lines.collapse@1": lambda t: F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"),
}


def clean(text: Column, ops: Iterable[str]) -> Column:
    for op in ops:
        text = CLEANUP[op](text)
    return text


def clean_by(rows: DataFrame, text: str, ops: str) -> DataFrame:
    """Apply each row's own ordered list of ops to a column, however long the lists are.

    The longest list is looked up first. Position by position, one expression picks the row's op;
    an unknown name is an error, never skipped. Each position is a step of its own, so what it reads
    is computed once.
    """
    longest = rows.agg(F.max(F.size(ops))).first()[0] or 0
    t = F.col(text)
    for i in range(longest):
        op = F.get(F.col(ops), F.lit(i))
        step = F.when(op.isNull(), t)
        for name, make in CLEANUP.items():
            step = step.when(op == name, make(F.when(op == name, t)))
        rows = rows.withColumn(text, step.otherwise(F.raise_error(F.concat(F.lit("no cleanup op "), op))))
    return rows


def join_appendices(texts: Column, before: str = "\n\n", between: str = "\n\n", after: str = "") -> Column:
    return F.when(F.size(texts) == 0, F.lit("")).otherwise(
        F.concat(F.lit(before), F.array_join(texts, between), F.lit(after))
    )


def snippet(text: Column, limit: int = 40) -> Column:
    """A text on one line, cut at a word, in quotes."""
    flat = strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))

    def cut(words: Column) -> Column:
        head = F.substring(words, 1, limit + 1)
        last_space = F.regexp_extract(head, r"(?s)^(.*) ", 1)
        kept = F.when(F.contains(head, F.lit(" ")), last_space).otherwise(head)
        return F.when(F.length(words) > limit, F.concat(kept, F.lit("…"))).otherwise(words)

    return F.concat(F.lit('"'), let(flat, cut), F.lit('"'))


def short(digest: Column) -> Column:
    return F.substring(F.regexp_replace(digest, "^sha256:", ""), 1, 6)


def count_of(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(
        n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s"))
    )


def flag_names(argv: Column) -> Column:
    """The flags an argument list sets: `_` reads as `-` in a name, up to its first dot."""

    def name(arg: Column) -> Column:
        flag = F.element_at(F.split(arg, "=", 2), 1)
        head = F.element_at(F.split(flag, r"\.", 2), 1)
        return F.concat(F.replace(head, F.lit("_"), F.lit("-")), F.substr(flag, F.length(head) + 1))

    return F.array_distinct(F.transform(F.filter(argv, lambda a: a.startswith("--")), name))
