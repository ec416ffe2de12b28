"""The corpus pipeline: five stages over ``documents``, from raw texts to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Cases, for every stage: a null text is an empty one, stays null and is never toxic by itself, contaminated or cut;
texts without words share one fingerprint, so one such document stays; rows of one id with different texts are
documents of their own, judged by their texts; rows that agree in id and text are judged alike and leave
near-dedup as one; rows without an id take part like others; of ties the smallest (id, text key) stays; very long
texts count whole; an empty table gives an empty one; other columns, whatever their names, come through as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.llm.common import fold, saved, table, text_key
from mediaprism.llm.decontamination import decontamination_report
from mediaprism.llm.line_dedup import dedup_lines
from mediaprism.llm.packing import pack
from mediaprism.llm.simhash import one_of_each_group
from mediaprism.llm.toxicity import fit_and_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The text alone is scored, so its key names the document, as an id may be null or repeat."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("found_text"))
    toxic = fit_and_score(texts, labels, also=(F.col("found_text"),)).where("predicted = 1").select("found_text").distinct()
    return docs.join(toxic, text_key(docs["text"]) == toxic["found_text"], "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays, that of the smallest id and text key; see the operator for null and repeated ids."""
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text alone decides, so its key names the document, as an id may be null or repeat."""
    texts = docs.select(text_key(F.col("text")).alias("found_text"), "text")
    found = decontamination_report(texts, table(spark, sf_dir, "benchmark"), id_col="found_text").where("contaminated").select("found_text").distinct()
    return docs.join(found, text_key(docs["text"]) == found["found_text"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn, merge byte pairs and solve linear programs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
