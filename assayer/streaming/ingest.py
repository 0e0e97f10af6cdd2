"""Streaming into the ledger: each row lands once, and progress is followed as it does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ledger import Ledger


def append_once(rows: DataFrame, path: str, checkpoint: str, keys: list[str], parts: int = 16) -> StreamingQuery:
    """Append a stream of rows to a bucketed ledger, each key once, however late a row is.

    `keys` begin with the column that names a row's log. No watermark stands before the ledger, so no row is lost.
    A batch's repeats are dropped, and by key what the buckets it touches have already, so a rerun adds nothing. A
    replayed batch is known by its number under the stream's id, which stays with the checkpoint.
    """
    ledger = Ledger(path, tuple(keys), parts=parts)

    def write(batch: DataFrame, number: int) -> None:
        ledger.append_new(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress(events: DataFrame) -> DataFrame:
    """Items started, ended and findings noted per run, from a stream of (run, event)."""
    return events.groupBy("run").agg(
        F.count_if(F.col("event") == "started").alias("started"),
        F.count_if(F.col("event") == "ended").alias("ended"),
        F.count_if(F.col("event") == "finding").alias("findings"),
    )
