"""A ledger in hash buckets: what an append must look at is a few buckets, never the whole store.

A row's bucket follows from its log and its key, so a batch can only meet rows of the buckets it touches, and
these are named to the reader before it plans: the scan lists them as partition filters. A log of any size is spread
over `parts` buckets. The layout is written with the store, since a row sought under another layout isn't found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
# Folders beside the buckets, which readers of the rows pass over.
LAYOUT, COMMITS = "_layout", "_commits"


class Conflict(ValueError):
    pass


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """What a path holds; None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def conflicts(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys a batch can't append: there twice, or stored already."""
    counts = batch.groupBy(*keys).agg(F.count("*").alias("n"))
    twice = counts.where("n > 1").select(*keys, F.lit("twice in the batch").alias("reason"))
    known = counts.join(stored.select(*keys), keys, "left_semi").select(*keys, F.lit("already stored").alias("reason"))
    return twice.unionByName(known)


@dataclass(frozen=True)
class Ledger:
    """Rows under a key whose first column names their log; `also` are further columns with folders of their own.

    There is one writer at a time: appends by two at once don't see each other.
    """

    path: str
    keys: tuple[str, ...]
    also: tuple[str, ...] = ()
    logs: int = 64
    parts: int = 16

    def bucket(self) -> Column:
        """From the log and the whole key as text, so that the same key has one bucket whatever its type."""
        text = lambda names: F.xxhash64(*[F.col(n).cast("string") for n in names])
        return (F.pmod(text(self.keys[:1]), F.lit(self.logs)) * self.parts + F.pmod(text(self.keys), F.lit(self.parts))).cast("int")

    def rows(self, spark: SparkSession) -> DataFrame | None:
        found = read(spark, self.path)
        return None if found is None else found.drop(BUCKET)

    def held(self, batch: DataFrame) -> DataFrame | None:
        """The keys stored in the buckets that the batch touches, of which there are logs * parts at most."""
        stored = read(batch.sparkSession, self.path)
        if stored is None:
            return None
        self._same_layout(batch.sparkSession)
        folders = [*self.also, BUCKET]
        touched = batch.withColumn(BUCKET, self.bucket()).select(*[F.collect_set(c).alias(c) for c in folders]).first()
        for name in folders:
            stored = stored.where(F.col(name).isin(touched[name]))
        return stored.select(*self.keys)

    def append(self, batch: DataFrame) -> None:
        """Append rows; a key that is doubled or stored already fails the whole batch."""
        stored = self.held(batch)
        if (bad := conflicts(batch, batch.limit(0) if stored is None else stored, list(self.keys)).head(1)):
            raise Conflict(f"{bad[0].reason}: {bad[0].asDict()}")
        self._write(batch)

    def append_new(self, batch: DataFrame, source: str | None = None, number: int = 0) -> int:
        """Append what is new of a batch, each key once; the number of buckets it looked at.

        A batch that `source` has numbered is noted when it is written. Noted ones are passed over unread; a replay
        of one that was cut off before finds what was written by key.
        """
        spark = batch.sparkSession
        notes = f"{self.path}/{COMMITS}/{source}"
        noted = None if source is None else read(spark, notes)
        if noted is not None and noted.where(F.col("number") == number).head(1):
            return 0
        new, stored = batch.dropDuplicates(list(self.keys)), self.held(batch)
        if stored is not None:
            same = [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in self.keys]
            new = new.join(stored.select(*[F.col(k).alias(f"_stored_{k}") for k in self.keys]), same, "left_anti")
        self._write(new)
        if source is not None:
            spark.range(1).select(F.lit(number).cast("bigint").alias("number")).coalesce(1).write.mode("append").parquet(notes)
        return batch.select(F.count_distinct(self.bucket())).first()[0]

    def _write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        if read(spark, f"{self.path}/{LAYOUT}") is None:
            layout = spark.range(1).select(F.lit(self.logs).alias("logs"), F.lit(self.parts).alias("parts"), F.lit(",".join(self.keys)).alias("keys"))
            layout.coalesce(1).write.parquet(f"{self.path}/{LAYOUT}")
        # One file a bucket and batch.
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(*self.also, BUCKET)
        dealt.write.mode("append").partitionBy(*self.also, BUCKET).parquet(self.path)

    def _same_layout(self, spark: SparkSession) -> None:
        found = read(spark, f"{self.path}/{LAYOUT}")
        found = None if found is None else tuple(found.first())
        if found != (self.logs, self.parts, ",".join(self.keys)):
            raise ValueError(f"{self.path} is laid out as {found}")
