"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results: they are set on any session the library is given.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


# Into how many partitions heavy inputs are dealt; unset, they stay as they are read. Set it where the
# input files have fewer row groups than there are cores.
DEAL = "assayer.input.partitions"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on; leave resources to the cluster."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local(cores: str = "8", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assayer")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config(DEAL, cores)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in {**SEMANTICS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dealt(frame: DataFrame) -> DataFrame:
    """The rows dealt out to as many partitions as the session asks for; as they are if it doesn't."""
    partitions = frame.sparkSession.conf.get(DEAL, None)
    return frame if partitions is None else frame.repartition(int(partitions))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's, or one of our own where none is set.

    A machine-local folder is only taken on a local master; a cluster without a shared
    folder is refused, since a lost executor could not read its checkpoint back.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="assayer-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What a job in here shuffles is dropped when the job is done, where Spark can do so."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and reread it: lineage ends here.

    Executors can be lost afterwards without anything above being computed again. The files stay
    until the owner of spark.checkpoint.dir clears it, since results are read lazily from them. What the
    write itself shuffled is dropped when it is done, where Spark can do so.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    with tidy(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
