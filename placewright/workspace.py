"""Tables that cut a lineage.

A staged table is plain Parquet in the shared folder the session names in ``spark.checkpoint.dir``, so it outlives any
executor, keeps column pruning and filter pushdown, and gives the planner true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows of a staged table that may be broadcast, after they have been counted; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only in local mode, where driver and tasks share a disk."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(staged: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``staged``, a table of few narrow rows, with a broadcast hint if it is counted to be one, else as it is."""
    return F.broadcast(staged) if staged.count() <= most else staged
