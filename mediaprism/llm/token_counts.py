"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

Cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are one token
each (the library's default); repeated rows give repeated rows; an empty table gives none; other
columns of the input are neither read nor returned; of pairs of one rank the leftmost merges first; very long runs cost O(n log n) by the heap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaprism.llm.tokenization import byte_counts


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file, the same on every executor. A narrow
    stage: no shuffle, and a lost task runs again on its own split.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches):
        counter = byte_counts(tokenizer)
        for b in batches:
            n = pa.array([counter.count(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
