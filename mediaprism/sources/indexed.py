"""Renditions behind a segment index: the index is read by range, and so are the indexes it names, until all entries are media.

Each round is one fetch of all ranges that are still to be read and one Arrow parse, written before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.media.indexes import MOST_DEPTH, sidx
from mediaprism.storage import saved

_ENTRY = "array<struct<offset:bigint,size:bigint,duration:bigint,is_index:boolean>>"
_KIND = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("duration", pa.int64()), ("is_index", pa.bool_())]))


def _parsed(answers: DataFrame) -> DataFrame:
    keys = [c for c in answers.columns if c != "body"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.select(*keys).schema)

    def run(batches):
        for b in batches:
            scales, entries = [], []
            for body, at in zip(b.column(len(keys)), b.column("offset").to_pylist(), strict=True):
                x = sidx(body.as_py() or b"", at or 0) or {"timescale": None, "entries": []}
                scales.append(x["timescale"])
                entries.append([{k: e[k] for k in ("offset", "size", "duration", "is_index")} for e in x["entries"]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scales, pa.int64()), pa.array(entries, _KIND)], [*keys, "timescale", "entries"])

    return answers.select(*keys, "body").mapInArrow(run, f"{kept}, timescale long, entries {_ENTRY}")


def expand(indexes: DataFrame, fetch: Callable[[DataFrame], DataFrame], depth: int = MOST_DEPTH) -> DataFrame:
    """Media entries of indexes (uri, offset, length, and keys that stay): the keys, uri, range_offset, range_length, ticks (start), duration_ticks, timescale and n (their order, from 0).

    What is still an index ``depth`` reads down is a circle or a mistake; it gives no entries.
    """
    keys = [c for c in indexes.columns if c not in ("uri", "offset", "length")]
    todo = indexes.withColumn("path", F.array().cast("array<int>"))
    media = None
    for _ in range(depth):
        answers = fetch(todo).where("error IS NULL").select(*keys, "uri", "path", "offset", "body")
        read = saved(_parsed(answers))
        e = read.select(*keys, "uri", "timescale", "path", F.posexplode("entries").alias("k", "e")).select(*keys, "uri", "timescale", F.concat("path", F.array("k")).alias("path"), "e.*")
        found = e.where("NOT is_index")
        media = found if media is None else media.unionByName(found)
        todo = e.where("is_index").select(*keys, "uri", "path", "offset", F.col("size").alias("length"))
        if todo.isEmpty():
            break
    # Paths order the entries of nested indexes as they stand in the file.
    from pyspark.sql import Window

    order = Window.partitionBy(*keys, "uri").orderBy("path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return media.select(*keys, "uri", F.col("offset").alias("range_offset"), F.col("size").alias("range_length"), F.coalesce(F.sum("duration").over(before), F.lit(0)).alias("ticks"), F.col("duration").alias("duration_ticks"), "timescale", (F.row_number().over(order) - 1).cast("long").alias("n"))
