"""Score aggregates by name. Nulls (unscored) are left out; too few values give 0.0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def std(value: Column) -> Column:
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def var(value: Column) -> Column:
    return F.coalesce(F.var_samp(value), F.lit(0.0))


def stderr(value: Column) -> Column:
    n = F.count(value)
    return F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(0.0))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": mean,
    "stderr": stderr,
    "std": std,
    "var": var,
}


def summary(value: Column, digits: int | None = None) -> list[Column]:
    """All aggregates with the numbers of scored and unscored values."""
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return [shown(make(value)).alias(name) for name, make in AGGREGATES.items()] + [
        F.count(value).alias("n"),
        F.count_if(value.isNull()).alias("n_unscored"),
    ]
