"""Stored components and ledger rows: adding once, appending without overwriting, reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import windows
from ..session import checkpoint_dir
from .ledger import Conflict, Ledger, conflicts

__all__ = ["Conflict", "add", "append", "conflicts", "corrupt", "inconsistent", "read_log", "to_add"]

# Folders of a kind's components by digest.
COMPONENT_BUCKETS = 64


def to_add(batch: DataFrame, stored: DataFrame, key: str = "digest") -> DataFrame:
    """A batch's components that aren't stored yet, each once. Adding again adds nothing."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def add(batch: DataFrame, path: str) -> None:
    """Append what is new of a batch to a component table, partitioned by kind and by the digests' hashes."""
    Ledger(path, ("digest",), ("kind",), logs=COMPONENT_BUCKETS, parts=1).append_new(batch)


def append(batch: DataFrame, path: str, keys: list[str], partition_by: str = "row_type") -> None:
    """Append ledger rows; a key that is doubled or stored already fails the whole batch."""
    Ledger(path, tuple(keys), (partition_by,)).append(batch)


def corrupt(components: DataFrame) -> DataFrame:
    """Components whose digest isn't that of their canonical text."""
    return components.where(F.col("digest") != hashing.digest(F.col("canonical")))


def inconsistent(rows: DataFrame, payload: str, columns: dict[str, str]) -> DataFrame:
    """Rows whose key columns differ from the members of their payload document, one row per column."""
    doc = F.parse_json(F.col(payload))
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.try_variant_get(doc, path, "string").eqNullSafe(F.col(column).cast("string")), F.lit(column)
                )
                for column, path in columns.items()
            ]
        )
    )
    return rows.withColumn("column", F.explode(found))


def read_log(started: DataFrame, *parts: DataFrame) -> DataFrame:
    """Logs read back, (log_id, position, line): the started row first, then each part's rows in canonical order.

    All rows are range partitioned by log and line, which cuts a log of any size into chunks of about
    equal depth along its order; the cut is kept in the checkpoint folder, so that numbers given by it
    stand when a partition is computed again.
    """
    rows = started.select("log_id", F.concat(F.lit("0started "), "started").alias("line"))
    for place, part in enumerate(parts, 1):
        rows = rows.unionByName(part.select("log_id", F.concat(F.lit(str(place)), "canonical").alias("line")))
    checkpoint_dir(rows.sparkSession)
    cut = rows.repartitionByRange("log_id", "line").withColumn("_cut", F.spark_partition_id()).checkpoint()
    placed = windows.numbered(cut, ["log_id"], F.col("_cut"), ["line"], "position")
    return placed.select("log_id", "position", F.substr("line", F.lit(2)).alias("line"))
