"""What the operators of this subpackage share: reading tables, cutting lineage, stable folds."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset on one machine, as in tests, a
    new temporary folder is taken and kept for the session; on a cluster it has to be set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="mediaprism-")
        sc.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    The files survive the loss of an executor, later plans read only the columns they need,
    and what a non-deterministic order has decided stays decided.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, mod: int) -> Column:
    """``crc32(column as text) mod n``, the folds by which labels are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def sampled(key: str, salt: str, share: Column) -> Column:
    """Whether a row is in a sample that holds ``share`` (0 to 1) of the rows, by a hash of its key.

    The hash has 63 bits, so a share of one row in 10^15 is still met; equal keys are in or out together.
    """
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(salt)), 1) < share * float(1 << 63)


def text_key(text: Column) -> Column:
    """128 bits that name a text; a null text has a name of its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


_RESIDENT: dict = {}


def resident(make: Callable, *args):
    """What a worker makes once and keeps from task to task, such as a table of words; one such thing at a time, the last one goes before the next is made."""
    if (make, *args) not in _RESIDENT:
        make_room()
        _RESIDENT[make, *args] = make(*args)
    return _RESIDENT[make, *args]


def make_room() -> None:
    """Lets go what a worker still keeps of other stages, and memory that Arrow has freed but not given back.

    Workers outlive stages, so a stage that holds much itself calls this in its tasks first.
    """
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


class Kept(dict):
    """What keys were found to give, as far as ``room`` bytes hold; long keys are not kept.

    ``find`` gives the value of a key that is not there.
    """

    def __init__(self, find: Callable, room: int = 48 << 20, longest: int = 64):
        self.find, self.room, self.longest = find, room, longest

    def __missing__(self, key):
        value = self.find(key)
        if len(key) <= self.longest and self.room > 0:
            self[key] = value
            # A key, its place in the table and a small value, as Python holds them.
            self.room -= 250 + len(key) + (len(value) if hasattr(value, "__len__") else 0) * 8
        return value
