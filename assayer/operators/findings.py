"""Findings: what a check has to say about a log or component, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

COLUMNS = ["level", "code", "message", "subject", "log_id"]


def message(*parts: Column | str) -> Column:
    """Text with values in it; strings are literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def finding(
    rows: DataFrame,
    code: str | Column,
    text: Column | str,
    subject: Column | None = None,
    log_id: Column | None = None,
    level: str | Column = "warning",
) -> DataFrame:
    literal = lambda v: F.lit(v) if v is None or isinstance(v, str) else v
    return rows.select(
        literal(level).alias("level"),
        literal(code).alias("code"),
        literal(text).alias("message"),
        literal(subject).cast("string").alias("subject"),
        literal(log_id).cast("string").alias("log_id"),
    )


def each(rows: DataFrame, checks: list[tuple[Column, str, Column | str, str | Column]], **ids) -> DataFrame:
    """Several checks of one row in one pass: (condition, code, message, level) each."""
    literal = lambda v: F.lit(v) if isinstance(v, str) else v
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(condition, F.lit(False)),
                    F.struct(literal(level).alias("level"), F.lit(code).alias("code"), literal(text).alias("message")),
                )
                for condition, code, text, level in checks
            ]
        )
    )
    subject, log_id = ids.get("subject"), ids.get("log_id")
    return rows.select(
        F.explode(found).alias("f"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
        (F.lit(None) if log_id is None else log_id).cast("string").alias("log_id"),
    ).select("f.level", "f.code", "f.message", "subject", "log_id")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def settled(*frames: DataFrame) -> DataFrame:
    """Their union, each written before the next is begun: what only one of them shuffles is on disk at a time."""
    return union(*[kept(frame) for frame in frames])


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "level").agg(
        F.count("*").alias("n"), F.count_distinct("log_id").alias("n_logs")
    )
