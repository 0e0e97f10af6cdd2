"""Captured server-sent event streams: their payloads in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def payloads(stream: Column) -> Column:
    """The data of each event of a stream, up to the one that ends it: array<string>.

    Events are parted by blank lines; an event's data lines are joined, one leading space
    dropped from each, and other fields and comments are ignored.
    """
    lines = F.regexp_replace(stream, r"\r+(?=\n|\z)", "")
    events = F.split(lines, r"\n{2,}")

    def data(event: Column) -> Column:
        found = F.filter(F.split(event, "\n"), lambda line: line.rlike(r"^data(:|\z)"))
        return F.when(
            F.size(found) > 0,
            F.array_join(F.transform(found, lambda line: F.regexp_replace(line, r"^data:? ?", "")), "\n"),
        )

    every = F.filter(F.transform(events, data), lambda d: d.isNotNull())

    def before_end(found: Column) -> Column:
        end = F.array_position(found, "[DONE]")
        return F.when(end > 0, F.slice(found, F.lit(1), (end - 1).cast("int"))).otherwise(found)

    return F.element_at(F.transform(F.array(every), before_end), 1)


def problem(payload: Column) -> Column:
    """Why a payload is no chunk: it isn't a JSON object, or it reports an error."""
    v = F.try_parse_json(payload)
    return F.when(F.coalesce(v.try_cast("map<string,variant>").isNull(), F.lit(True)), "not a JSON object").when(
        F.try_variant_get(v, "$.error", "variant").isNotNull(), "rejected"
    )


def payload_rows(streams: DataFrame, text: str, keys: list[str]) -> DataFrame:
    rows = streams.select(*keys, F.posexplode(payloads(F.col(text))).alias("seq", "payload"))
    return rows.withColumn("problem", problem(F.col("payload")))


def read_captured(spark: SparkSession, path: str) -> DataFrame:
    """Streams as they are captured, one file per call: whole files, since lines alone have no order."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(
        F.col("_metadata.file_name").alias("call_id"), F.col("value").alias("stream")
    )
