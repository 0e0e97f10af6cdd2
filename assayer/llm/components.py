"""Connected components of a graph that is as large as the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


# Links that one task contracts at a time.
LINKS = 1 << 18


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links' nodes that aren't the smallest they reach, each with the smallest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(names))
    x, y = ends[: len(a)], ends[len(a) :]
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    moved = np.flatnonzero(parent != np.arange(len(names)))
    return names[moved], names[parent[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's links as forests, each of at most about LINKS of them: each node with the smallest it reaches there."""
    held, n = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
        n += batch.num_rows
        if n >= LINKS:
            a, b = _forest(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [(a, b)], len(a)
            if n >= LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held, n = [], 0
    if n:
        a, b = _forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b) that isn't the smallest of its component.

    Links are contracted within blocks of LINKS at most. If there are more blocks than one, large and small stars
    alternate until every node hangs on the smallest: a number of rounds logarithmic in the longest chain. Each round's
    links are kept in the shared folder.
    """
    found = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n = links.count()
    edges = kept(found.coalesce(n // LINKS + 1).mapInArrow(_local, "a long, b long"))
    if n < LINKS:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    edges = kept(edges.distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: the larger neighbours of a node hang on the smallest of its neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.filter("a <> b").distinct())
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = kept(small.filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, on which nothing else hangs."""
    ends = edges.select("a", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    counted = ends.groupBy("a").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not counted.filter("below > 1 OR (below = 1 AND above = 1)").limit(1).count()
