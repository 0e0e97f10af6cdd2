"""Named queries over the given tables, each with the SQL its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .tables import Given, oracle

QUERIES: dict[str, Callable[[Given], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle where SQL can express it."""

    def add(build: Callable[[Given], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def oracles() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLES.items()}
