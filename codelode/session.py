"""Reading the tables, cutting lineage, and proving that a frame is small enough to broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast after both were counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table, or only the named columns of it, so that the scan reads no others."""
    frame = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return frame.select(*columns) if columns else frame


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint that all executors can read.

    The folder is the one in ``spark.checkpoint.dir``. Where that is unset, a session on one machine, as in
    tests, takes a new temporary one; on a cluster, whose executors could not read that, it is an error.
    Spark removes what is no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = frame.sparkSession.sparkContext
    if not frame.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can read")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codelode-checkpoint-"))
    return frame.checkpoint(eager=True)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame has at most so many rows and bytes; it counts no further than one row more."""
    texts = [f.name for f in frame.schema.fields if not isinstance(f.dataType, T.NumericType)]
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in texts), F.lit(8 * len(frame.columns)))
    found = frame.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def broadcast_if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it was counted to be small, else unchanged (Spark shuffles)."""
    return F.broadcast(frame) if small(frame, rows) else frame


def spread(frame: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as tasks run at once, for work that costs far more than moving the rows.

    A table of a few small files is one partition, and one task would do all of it.
    """
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= tasks else frame.repartition(tasks)
