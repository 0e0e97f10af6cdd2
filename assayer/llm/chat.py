"""Chat formatting by a declarative template: marked turns, escaped texts, and the segments that carry loss.

The template names its marks, how each role's text counts towards the loss, and which role may follow which: a
finite-state machine whose state is the role read last. Marks inside texts and role names are escaped, and the
escape sign itself is, so what was formatted can be read back. A task streams its sorted turns (see `turns`);
conversations that touch a task's edge or are too long to hold come in pieces, each formatted for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, task
from .turns import PIECE_ROWS, in_order, pieces, streamed, turns_of


@dataclass(frozen=True)
class Template:
    """A turn is `open`, the role, `named`, the text, `close`; `follows` names the roles after a role ('' at the start)."""

    open: str = "<turn:"
    named: str = ">\n"
    close: str = "</turn>\n"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.open, self.named, self.close
        if len(self.escape) != 1 or not all(marks) or any(self.escape in mark for mark in marks):
            raise ValueError("marks must be there and the escape sign, one character, must not be in them")

    def escaped(self, text: str) -> str:
        return self._marks().sub(lambda m: self.escape + m[0], text)

    def plain(self, text: str) -> str:
        sign = re.escape(self.escape)
        return re.sub(f"{sign}(.)", lambda m: m[1], text, flags=re.S)

    def _marks(self) -> re.Pattern:
        # Where the first sign of a mark is escaped, the mark can't be read.
        return re.compile("[" + re.escape(self.escape + self.open[0] + self.named[0] + self.close[0]) + "]")

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's text in parts, each with whether it counts towards the loss; empty parts are left out."""
        parts = [(self.open + self.escaped(role) + self.named, False), (self.escaped(text), role in self.loss), (self.close, False)]
        return [part for part in parts if part[0]]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """What was formatted: the roles and texts."""
        inside = f"((?:[^{re.escape(self.escape)}]|{re.escape(self.escape)}.)*?)"
        found, at = [], 0
        turn = re.compile(f"{re.escape(self.open)}{inside}{re.escape(self.named)}{inside}{re.escape(self.close)}", re.S)
        while at < len(text):
            match = turn.match(text, at)
            if match is None:
                raise ValueError(f"no turn at character {at}")
            found.append((self.plain(match[1]), self.plain(match[2])))
            at = match.end()
        return found

    def allows(self, before: str, role: str) -> bool:
        return role in self.follows.get(before, ())


FORMATTED = "conv_id long, part int, piece int, whole boolean, n_turns long, first_role string, last_role string, fault long, formatted string, loss array<struct<start:bigint,length:bigint>>"
_FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("first_role", pa.string()),
        ("last_role", pa.string()), ("fault", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)


def format_chats(rows: DataFrame, template: Template = Template(), piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Formatted conversations from (conv_id, turn, role, text), in pieces of which most are whole conversations.

    `formatted` is a piece's text and `loss` the spans of its characters that count towards the loss, in order;
    pieces of one conversation follow each other by (part, piece) and simply join. `fault` is the first turn, from 0
    within the piece, whose role may not follow the one before it; a piece's first turn is judged with the piece
    before it (`judged`). Rows come by turn, nulls first, ties by role, then text; equal rows are all formatted. Null
    roles and texts are empty; roles that the template doesn't know are formatted and a fault; a null conv_id is a
    conversation of its own; other columns are left out; an empty table gives an empty result. A row's text must
    fit in memory, a conversation needn't.
    """
    given = turns_of(rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, part = [], 0, task()
        for conv, piece, whole, found in pieces(_single(streamed(batches)), piece_rows):
            texts, spans, at, fault = [], [], 0, None
            for place, row in enumerate(found):
                if place and fault is None and not template.allows(found[place - 1]["role"], row["role"]):
                    fault = place
                for text, loss in template.segments(row["role"], row["text"]):
                    if loss:
                        spans.append({"start": at, "length": len(text)})
                    texts.append(text)
                    at += len(text)
            out.append((conv, part, piece, whole, len(found), found[0]["role"], found[-1]["role"], fault, "".join(texts), spans))
            held += at
            if len(out) >= 1000 or held > 1 << 22:
                yield _rows(out, _FORMATTED)
                out, held = [], 0
        if out:
            yield _rows(out, _FORMATTED)

    return in_order(given).mapInArrow(run, FORMATTED)


def _single(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        for _ in range(row["n"]):
            yield row


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


READ = "conv_id long, part int, piece int, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, first_role string, last_role string, fault long, formatted string, loss array<struct<start:bigint,length:bigint>>"
_READ = pa.schema(
    [
        *list(_FORMATTED)[:5], ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), *list(_FORMATTED)[5:],
    ]
)


class Digest:
    """What is read back of a conversation, piece by piece."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, template: Template, formatted: str, spans: list[dict]) -> None:
        for role, text in template.turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            text = template.plain(formatted[span["start"] : span["start"] + span["length"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fault) of each conversation's output.

    Whole conversations are read where they were formatted. Pieces of the others follow each other through one task
    as a stream, since a digest is a chain. `fault` is the first turn, from 0, that the template's order doesn't allow,
    the number of turns if only the end isn't allowed, else null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                found = None, None, None, None
                formatted, loss = row["formatted"], row["loss"]
                if row["whole"]:
                    digest = Digest()
                    digest.add(template, formatted, loss)
                    found, formatted, loss = digest.row()[1:], None, None
                out.append((*[row[c] for c in ("conv_id", "part", "piece", "whole", "n_turns")], *found, row["first_role"], row["last_role"], row["fault"], formatted, loss))
            if out:
                yield _rows(out, _READ)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([f for f in _READ if f.name in _DONE])
        last, digest, fault, before = None, None, None, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if last is None or last["conv_id"] != row["conv_id"]:
                    if last is not None:
                        out.append((last["conv_id"], *digest.row(), _fault(template, digest.n_turns, fault, last["last_role"])))
                    digest, fault, before = Digest(), None, ""
                if fault is None:
                    known = 0 if not template.allows(before, row["first_role"]) else row["fault"]
                    fault = None if known is None else digest.n_turns + known
                digest.add(template, row["formatted"], row["loss"])
                last, before = row, row["last_role"]
            if out:
                yield _rows(out, schema)
        if last is not None:
            yield _rows([(last["conv_id"], *digest.row(), _fault(template, digest.n_turns, fault, last["last_role"]))], schema)

    parts = kept(formatted.mapInArrow(read, READ))
    allowed = F.col("first_role").isin(*template.follows.get("", ()))
    ended = F.when(~F.col("last_role").isin(*template.ends), F.col("n_turns"))
    whole = parts.filter("whole").withColumn("fault", F.coalesce(F.when(~allowed, F.lit(0).cast("long")), "fault", ended)).select(*_DONE)
    rest = parts.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(rest.mapInArrow(stream, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _DONE)))


_DONE = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]


def _fault(template: Template, n_turns: int, fault: int | None, last_role: str) -> int | None:
    return n_turns if fault is None and last_role not in template.ends else fault


# The contract's own conversation, which holds marks in its texts.
OWN = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN, "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(own)))
