"""The clock that a live manifest goes by: what the time sources it names say, against this machine's.

Each distinct address is asked once, whatever number of streams name it; of a stream's sources the first that answers counts. Where time travelled over a network, half
the request's time is added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaprism.functions import text
from mediaprism.storage import saved


def form(scheme: Column) -> Column:
    """How a source is asked; null for schemes that are not spoken."""
    s = F.lower(scheme)
    return F.when(s.contains("utc:direct"), "direct").when(s.contains("utc:http-head"), "head").when(s.contains("utc:http-iso") | s.contains("utc:http-xsdate"), "body")


def resolve(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], local_us: Column | None = None) -> DataFrame:
    """Of sources (stream, n, scheme, value) one row a stream: stream, sources, spoken (any is of a known form), now_us and skew_us (null if none answered)."""
    local = F.unix_micros(F.current_timestamp()) if local_us is None else local_us
    s = saved(sources.select("stream", "n", "value", form(F.col("scheme")).alias("form")))
    asked = s.where("form IN ('head', 'body')").select(F.col("value").alias("uri"), "form").distinct()
    asked = asked.select("uri", F.when(F.col("form") == "head", 0).cast("long").alias("offset"), F.when(F.col("form") == "head", 1).cast("long").alias("length"), "form")
    got = fetch(asked).where("error IS NULL")
    half = (F.coalesce("elapsed_us", F.lit(0)) / 2).cast("long") if "elapsed_us" in got.columns else F.lit(0)
    said = F.when(F.col("form") == "head", text.http_date(text.header(F.col("headers"), "date"))).otherwise(text.lenient_utc(F.regexp_replace(F.col("body").cast("string"), r"^\s+|\s+$", "")))
    answers = saved(got.select(F.col("uri").alias("value"), "form", (F.unix_micros(said) + half).alias("there_us"), local.alias("local_us")))
    direct = F.unix_micros(text.lenient_utc(F.col("value")))
    x = s.join(answers, ["value", "form"], "left").withColumns({"there_us": F.when(F.col("form") == "direct", direct).otherwise(F.col("there_us")), "local_us": F.coalesce("local_us", local)})
    first = F.min_by(F.struct("there_us", "local_us"), F.when(F.col("there_us").isNotNull(), F.col("n"))).alias("f")
    g = x.groupBy("stream").agg(F.count("*").alias("sources"), F.max(F.col("form").isNotNull()).alias("spoken"), first)
    return saved(g.select("stream", "sources", "spoken", F.col("f.there_us").alias("now_us"), (F.col("f.there_us") - F.col("f.local_us")).alias("skew_us")))
