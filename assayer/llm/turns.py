"""Conversations in order as streams: sorted over all tasks, cut into pieces, so that none is gathered.

Rows are range partitioned by conversation and turn, so a conversation of any size is spread over tasks. A task
streams its sorted rows. What begins and ends inside a task is a whole conversation; what touches a task's edge,
or is too long to hold, becomes pieces whose order is (part, piece), to be put together by whoever needs that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and bytes of text that a piece holds at most (one row more than the bytes allow).
PIECE_ROWS, PIECE_BYTES = 256, 4 * 1024 * 1024
# Characters of a text that tell rows of one conversation, turn and role apart when ranges are drawn.
PREFIX = 64


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the turns with n rows that are alike in all four, as far as a batch shows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("n", pa.array([1] * batch.num_rows, pa.int64()))
            merged = table.group_by(["conv_id", "turn", "role", "text"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
            yield from merged.select(["conv_id", "turn", "role", "text", "n"]).to_batches()

    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).mapInArrow(run, "conv_id long, turn long, role string, text string, n long")


def in_order(rows: DataFrame) -> DataFrame:
    """All rows by conversation and turn, nulls first; ties by role, then text."""
    return rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of sorted batches, those alike in conversation, turn, role and text as one with the sum of their `n`."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if last is not None and all(last[c] == row[c] for c in ("conv_id", "turn", "role", "text")):
                last["n"] += row["n"]
                continue
            if last is not None:
                yield last
            last = row
    if last is not None:
        yield last


def pieces(rows: Iterator[dict], most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> Iterator[tuple[int | None, int, bool, list[dict]]]:
    """(conv_id, piece, whole, rows): a task's stream cut by conversation and size; pieces are numbered through the task."""
    held: list[dict] = []
    size, piece, first, cut = 0, 0, True, False
    for row in rows:
        other = bool(held) and held[-1]["conv_id"] != row["conv_id"]
        if held and (other or len(held) >= most_rows or size >= most_bytes):
            yield held[-1]["conv_id"], piece, other and not first and not cut, held
            piece, held, size = piece + 1, [], 0
            first, cut = first and not other, not other
        held.append(row)
        size += len(row["text"])
    if held:
        yield held[-1]["conv_id"], piece, False, held
