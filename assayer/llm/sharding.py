"""A uniform shuffle into shards of exact sizes, by a drawn communication matrix.

Each partition permutes its rows; how many of them go to each shard is drawn beforehand, partition after
partition, from the multivariate hypergeometric distribution, which is what a uniform permutation of all
rows would give. Rows then move once, and every shard permutes what it got in buckets of random keys.
The matrix has one small row per partition and is all that the driver sees.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, kept

# The row's place within its partition is in the low bits of monotonically_increasing_id().
PLACE_BITS = 33
# Rows that one window of the second permutation should hold on average, and the fewest windows.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 16


def hypergeometric(rng: random.Random, total: int, good: int, draws: int) -> int:
    """How many of `good` among `total` are in a sample of `draws`: inverse of the distribution, walked from its mode."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    left = rng.random() - at
    down = up = mode
    below = above = at
    while left > 0 and (down > low or up < high):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            left -= above
            if left <= 0:
                return up
        if down > low:
            below *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= below
            if left <= 0:
                return down
        if above < 1e-300 and below < 1e-300:
            break
    return mode


def matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """For each partition of `counts` rows, how many go to each shard, so that shard j gets exactly sizes[j]."""
    rng, left, total, rows = random.Random(seed), list(sizes), sum(counts), []
    for count in counts:
        row, draws, rest = [], count, total
        for shard, size in enumerate(left):
            got = hypergeometric(rng, rest, size, draws) if rest else 0
            row.append(got)
            draws, rest = draws - got, rest - size
            left[shard] -= got
        total -= count
        rows.append(row)
    return rows


def shuffle(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """(row, shard, slot): every row of a frame, as a struct, in a shard and at a place gapless from 0.

    Shard sizes differ by one at most. Rows are taken as they are, nulls, ties and repeated rows included,
    and any column names; an empty frame gives an empty result.
    """
    spark = rows.sparkSession
    local = rows.select(F.struct("*").alias("row"), F.rand(seed).alias("first"), F.rand(seed + 1).alias("second"))
    place = F.monotonically_increasing_id()
    permuted = local.sortWithinPartitions("first").select("row", "second", place.alias("place"))
    permuted = kept(permuted).select(
        "row", "second", F.shiftright("place", PLACE_BITS).alias("part"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).alias("rank")
    )
    counted = sorted(tuple(r) for r in permuted.groupBy("part").count().collect())
    total = sum(n for _, n in counted)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    ends = []
    for (part, _), row in zip(counted, matrix([n for _, n in counted], sizes, seed), strict=True):
        ends.append({"part": part, "ends": [sum(row[: j + 1]) for j in range(shards)]})
    drawn = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:bigint,ends:array<bigint>>>")))
    buckets = max(LEAST_BUCKETS, -(-total // (shards * BUCKET_ROWS)))
    sent = permuted.join(kept(drawn), "part").select(
        "row",
        "second",
        F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard"),
        F.least(F.floor(F.col("second") * buckets), F.lit(buckets - 1)).cast("int").alias("bucket"),
    )
    filled = sent.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept(filled.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start")))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("second"))
    numbered = sent.withColumn("within", within).join(starts, ["shard", "bucket"])
    return numbered.select("row", "shard", (F.col("start") + F.col("within") - 1).alias("slot"))


def op3_matrix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle(rows, 8).select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
