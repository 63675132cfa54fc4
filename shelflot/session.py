"""Session construction and the shared folder for checkpoints and run output."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where an aggregate above wanted its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Rows of a join's larger side that a task is meant to get.
ROWS_PER_TASK = 500_000


def build_session(app: str = "shelflot", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder; on a cluster that
    folder would be lost with its machine, so there the setting is required.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelflot-"))
    return context.getCheckpointDir()


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run's written tables."""
    return f"{shared_dir(spark).rstrip('/')}/shelflot-{label}-{uuid.uuid4().hex[:12]}"


def pinned(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Tasks to spread a heavy step over: the shuffle setting, and never fewer than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@contextmanager
def spread_over(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK):
    """Plan the jobs run inside with enough shuffle partitions for ``rows``, so that a task's share stays the same."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, max(int(before), -(-rows // per_task)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
