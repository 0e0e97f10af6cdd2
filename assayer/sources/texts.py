"""Sources of vignettes: folders of text files, and their snapshots as cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing


def folder(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """The text files of a folder: id (file name as it is, without suffix) and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substr(name, F.lit(1), F.length(name) - len(suffix)).alias("source_id"), "content")


def listing(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """The ids alone: no content is read."""
    return folder(spark, path, suffix).select("source_id")


def snapshot(files: DataFrame, source: str) -> DataFrame:
    """Each file as a case: source, id and the fingerprint of its bytes."""
    return files.select(
        F.lit(source).alias("source"), "source_id", hashing.fingerprint(F.col("content")).alias("hex")
    )


def decoded(content):
    """UTF-8 text without a leading byte-order mark; null where the bytes aren't UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content), r"^\x{FEFF}", "")
