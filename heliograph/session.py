"""Session setup and the few cluster-facing helpers every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Keyed state of long horizons stays off the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows and bytes of an Arrow batch of texts; a longer text is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 24
# Rows of a shuffle partition where rows are many, and the bytes up to which adaptive execution joins partitions:
# strings of one prefix take ten times as much in a task.
TASK_ROWS, TASK_BYTES = 250_000, 2 << 20


def build_session(app: str = "heliograph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster, master, memory and ``spark.sql.shuffle.partitions`` come from
    spark-submit; nothing here overrides them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    base = os.path.join(tempfile.gettempdir(), f"heliograph-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; never reused, never cleaned here."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Truncates the plan and survives executor loss like a checkpoint, but computes
    the rows once and gives the planner their true size.
    """
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_parts(spark: SparkSession, parts: int):
    """Jobs run inside shuffle into ``parts`` partitions; the session's own number is put back."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, parts)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int):
    """Jobs run inside sort and aggregate in tasks of about TASK_ROWS rows however many ``rows`` there are; the session's
    own number of shuffle partitions is the least, and its settings are put back."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, TASK_BYTES)
    try:
        with shuffle_parts(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))):
            yield
    finally:
        spark.conf.set(size, before)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of each query run inside go when it ends; else they stay until the driver happens to collect its
    garbage, which may be after a whole loop. Persisted frames and written stages keep theirs."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has task slots,
    as for a small file under CPU-heavy text work; a large table is left alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def stored(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    Adjacent projections merge, so a costly column used in several places (a
    token array, say) would be computed at each. A generator over one row is a
    boundary the optimizer does not merge across; nothing is shuffled.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to BATCH_ROWS rows and BATCH_BYTES: batches of whole texts are large,
    and a task holds a batch on both sides of the pipe."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df


def keep(df: DataFrame) -> DataFrame:
    """Persist a reused frame, spilling to disk; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
