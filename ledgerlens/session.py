"""Session defaults, and the one place that decides where lineage is cut."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's own settings apply."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current is not None:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerlens-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but keeps column pruning, filter pushdown and size statistics, so a later
    join can see that the table is small enough to broadcast.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The lookup side of a join, marked for broadcast only after measuring it: at most ``rows`` rows and ``size`` bytes.

    Larger ones are joined by shuffle. Knowing the size beforehand spares the other side its shuffle.
    """
    kept = reused(df)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + F.lit(8) for c in df.columns), F.lit(16))
    found = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(kept) if found["n"] <= rows and found["b"] <= size else kept


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by the session's number of shuffle partitions, and keep that number.

    For rows that are few in bytes but costly to compute on: sized by bytes alone, they would be put into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


ROWS_OF_A_FIT = 100_000


def gathered(df: DataFrame, rows: int = ROWS_OF_A_FIT) -> DataFrame:
    """``df`` written, and kept in as many partitions as its rows need.

    A fit passes over its rows hundreds of times, and each pass is a job with a task for every partition, empty ones too.
    """
    held = materialized(df, "rows")
    return reused(held.coalesce(max(1, -(-held.count() // rows))))


T = TypeVar("T")


def at_once(spark: SparkSession, tasks: Sequence[Callable[[], T]], parallelism: int = 6) -> list[T]:
    """Results of several driver-side tasks, in order; so many at a time hand their jobs to the scheduler.

    One fit after the other would leave executors idle between its many small jobs.
    """
    if not tasks:
        return []
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return [r.get() for r in [pool.apply_async(inheritable_thread_target(spark)(t)) for t in tasks]]


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` for the passes of one report: persisted here unless the caller has, and then released again."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    held = reused(df)
    try:
        yield held
    finally:
        held.unpersist()


def reused(df: DataFrame) -> DataFrame:
    """Keep ``df`` for several passes. Lost blocks are recomputed from lineage, so executor loss is harmless."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@contextlib.contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``reused`` whose frames are released where the block ends."""
    frames: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        frames.append(reused(df))
        return frames[-1]

    try:
        yield hold
    finally:
        for df in frames:
            df.unpersist()


def swept(spark: SparkSession) -> None:
    """Drop the shuffle files of frames that are no longer used. Spark does so only when the driver collects its garbage, and a
    driver with a small plan and large shuffles has no reason to."""
    gc.collect()
    spark._jvm.System.gc()


def remembered(df: DataFrame) -> DataFrame:
    """Keep ``df`` in memory as far as it fits. What does not is computed again, so it has to be cheap; nothing goes to disk."""
    return df.persist(StorageLevel.MEMORY_ONLY)
