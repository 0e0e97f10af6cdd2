"""Running values over long groups, computed in two phases.

A window over one group runs in one task, and one run of a ledger may hold a third of all
rows. Each group is therefore cut into chunks along its order: the running value is taken
within a chunk, the chunks' totals are accumulated over the chunks, and the two are put
together. Chunks are a function of the row's own order key, so a recomputed partition
always lands in the same one. Rows are dealt out by group and chunk before a window or an
aggregate over both: without that, rows that a join has hashed by group would stay together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMBINE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
TAKE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    rows: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[str | Column],
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums, maxima or minima over the rows before each (or up to it).

    `chunk` must not decrease along `order`. A running value over no rows is null.
    """
    part = rows.withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    end = Window.currentRow if inclusive else -1
    inner = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = part.select(
        "*", *[TAKE[op](value).over(inner).alias(f"_in_{name}") for name, (op, value) in values.items()]
    )
    totals = part.groupBy(*keys, "_chunk").agg(
        *[TAKE[op](value).alias(f"_t_{name}") for name, (op, value) in values.items()]
    )
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys,
        "_chunk",
        *[TAKE[op](f"_t_{name}").over(outer).alias(f"_out_{name}") for name, (op, _) in values.items()],
    )
    joined = local.join(before, [*keys, "_chunk"])

    def whole(name: str, op: str) -> Column:
        inside, outside = F.col(f"_in_{name}"), F.col(f"_out_{name}")
        if op == "sum":
            both = F.when(inside.isNotNull() & outside.isNotNull(), inside + outside)
            return F.coalesce(both, inside, outside)
        return COMBINE[op](inside, outside)

    return joined.select(
        *[F.col(c) for c in rows.columns], *[whole(name, op).alias(name) for name, (op, _) in values.items()]
    )


def numbered(rows: DataFrame, keys: list[str], chunk: Column, order: list[str | Column], name: str) -> DataFrame:
    """Number a group's rows from 0 along an order."""
    counted = running(rows, keys, chunk, order, {name: ("sum", F.lit(1).cast("bigint"))})
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))


def previous(
    rows: DataFrame, keys: list[str], chunk: Column, order: str, fields: list[str], prefix: str = "prev_"
) -> DataFrame:
    """The fields of the row before each in its group, by a unique order column; null for the first.

    The greatest order key so far carries its row's fields along, so this is a running maximum.
    """
    carried = F.struct(order, *fields)
    found = running(rows, keys, chunk, [order], {"_prev": ("max", carried)})
    return found.select(
        *rows.columns,
        F.col(f"_prev.{order}").alias(f"{prefix}{order}"),
        *[F.col(f"_prev.{f}").alias(f"{prefix}{f}") for f in fields],
    )


# Spans of time, in the unit of the spans: chunks, and chunks' totals within one longer span.
SECOND, CHUNKS_AT_ONCE = 1_000_000, 3600


def peak(spans: DataFrame, key: str, start: str, end: str, width: int = SECOND) -> DataFrame:
    """How many spans overlap at most, per key; a span ending as another starts doesn't overlap it.

    Starts and ends are counted along time within chunks of `width`, the chunks' totals within
    every CHUNKS_AT_ONCE chunks, and theirs over the whole time.
    """
    steps = spans.select(
        key,
        F.inline(
            F.array(
                F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
                F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")),
            )
        ),
    ).withColumn("chunk", F.floor(F.col("at") / width))
    inner = Window.partitionBy(key, "chunk").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    chunks = (
        steps.repartition(key, "chunk")
        .withColumn("level", F.sum("step").over(inner))
        .groupBy(key, "chunk")
        .agg(F.sum("step").alias("total"), F.max("level").alias("top"))
    )
    based = running(chunks, [key], F.floor(F.col("chunk") / CHUNKS_AT_ONCE), ["chunk"], {"base": ("sum", F.col("total"))})
    top = F.coalesce("base", F.lit(0)) + F.col("top")
    return based.groupBy(key).agg(F.greatest(F.max(top), F.lit(0)).alias("peak"))


def longest_runs(
    rows: DataFrame, key: str, seq: str, blank: str, tokens: str, limit: int, width: int = 65_536
) -> DataFrame:
    """The longest stretch of blank tokens per key, whether it reaches the limit, and where it first does.

    With running totals of the tokens, a stretch up to a row is the total so far less the
    total at the last row that wasn't blank, which is a running maximum.
    """
    chunk = F.floor(F.col(seq) / width)
    summed = running(rows, [key], chunk, [seq], {"_total": ("sum", F.col(tokens))}, inclusive=True)
    reset = running(
        summed, [key], chunk, [seq], {"_reset": ("max", F.when(~F.col(blank), F.col("_total")))}, inclusive=True
    )
    stretch = F.when(F.col(blank), F.col("_total") - F.coalesce("_reset", F.lit(0))).otherwise(0)
    over = F.when(stretch >= limit, F.col(seq))
    return reset.groupBy(key).agg(
        F.max(stretch).cast("bigint").alias("longest"),
        (F.max(stretch) >= limit).alias("cut"),
        F.min(over).alias("cut_at"),
        F.min_by(stretch, over).cast("bigint").alias("cut_tokens"),
    )
