"""Bundles: roots with everything they reach, exported to a folder and verified on import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.findings import finding, message, union
from .store import corrupt


def export(roots: DataFrame, components: DataFrame, refs: DataFrame) -> DataFrame:
    """The components of a bundle, the roots marked."""
    reached = graph.closure(roots, refs)
    marked = roots.select("digest").distinct().withColumn("is_root", F.lit(True))
    return (
        components.join(reached, "digest", "left_semi")
        .join(marked, "digest", "left")
        .withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    )


def write(bundle: DataFrame, path: str) -> None:
    bundle.write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verify(components: DataFrame, roots: DataFrame, refs: DataFrame) -> DataFrame:
    """What is wrong with a bundle: bytes that don't match, roots and references it lacks."""
    missing_roots = roots.select("digest").distinct().join(components.select("digest"), "digest", "left_anti")
    return union(
        finding(
            corrupt(components), "bundle.digest", message(F.col("digest"), " does not match its bytes"),
            F.col("digest"), level="error",
        ),
        finding(missing_roots, "bundle.root", "root missing from bundle", F.col("digest"), level="error"),
        graph.broken(refs, components, components),
    )
