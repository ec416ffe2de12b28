"""Written tables: what is used more than once is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Jobs that one driver runs at a time.
SIDE_BY_SIDE = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. On one machine a temporary one will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="mediaprism-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _written(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/relation-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def saved_each(*frames: DataFrame) -> DataFrame:
    """The rows of frames of one schema, each written by a job of its own, so that the driver never holds one plan of them all; some run side by side."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        paths = list(pool.map(_written, frames))
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*paths)


def large(df: DataFrame) -> DataFrame:
    """One side of a join whose rows grow with the input: it meets the other by a shuffle. Spark takes the size of compressed files for that of their rows, and else sends millions of these whole through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where each costs much more than its bytes tell, as in front of a Python stage that makes or parses bodies."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
