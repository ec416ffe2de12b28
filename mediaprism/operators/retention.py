"""How much of a live window its origin still holds: a search by halves, for all windows at once.

An origin that has dropped a segment has dropped everything older, so four questions place the boundary. Each round asks one
segment of every window that is still open, in one join or fetch, and is written before the next: the plan stays short, and a lost
executor repeats one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.operators.common import EMPTY
from mediaprism.storage import large, saved

ROUNDS = 4
#: Segments of a window that may be asked; longer ones are asked at so many places.
PROBES = 16


def top_rungs(renditions: DataFrame, segments: DataFrame) -> DataFrame:
    """Of each stream the live video rendition of the highest bandwidth that has a window: one retention serves all rungs."""
    live = renditions.where("live AND NOT failed AND kind = 'video'").join(large(segments.select("rendition").distinct()), "rendition", "left_semi")
    best = Window.partitionBy("stream").orderBy(F.desc("bandwidth"), F.desc("rendition"))
    return live.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("stream", "rendition")


def windows_of(renditions: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """rendition, window_us and points (k, sequence, declared_us and ``columns``, oldest first) of each stream's top rung."""
    s = segments.join(top_rungs(renditions, segments).select("rendition"), "rendition", "left_semi")
    order = Window.partitionBy("rendition").orderBy("sequence")
    s = s.select("rendition", "sequence", "declared_us", *columns, (F.row_number().over(order) - 1).alias("k"), F.count("*").over(Window.partitionBy("rendition")).alias("n"), F.sum("declared_us").over(Window.partitionBy("rendition")).alias("window_us"))
    # The oldest and the newest are among the places asked.
    if_asked = (F.col("n") <= PROBES) | (F.floor(F.col("k") * (PROBES - 1) / (F.col("n") - 1)) > F.floor((F.col("k") - 1) * (PROBES - 1) / (F.col("n") - 1))) | (F.col("k") == 0)
    points = F.array_sort(F.collect_list(F.struct("sequence", "declared_us", *columns)))
    return s.where(if_asked).groupBy("rendition").agg(F.max("window_us").alias("window_us"), points.alias("points"))


def span_us(points: Column, found: Column) -> Column:
    """From a place to the newest: the segments between two places, each as long as the older one."""
    newest = F.size(points) - 1
    gap = lambda i: F.greatest(F.get(points, i + 1)["sequence"] - F.get(points, i)["sequence"], F.lit(1)) * F.get(points, i)["declared_us"]
    inner = F.aggregate(F.transform(F.sequence(found, newest - 1), gap), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(found >= newest, F.get(points, newest)["declared_us"]).otherwise(inner)


def measure(windows: DataFrame, holds: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """rendition, window_us, held (the oldest is there), since_us (what is, else; null if not measured) and fetches.

    ``holds`` takes requests (rendition and the fields of a point) and gives rendition and held of each.
    """
    windows = saved(windows)
    if windows.isEmpty():
        return windows.sparkSession.createDataFrame([], EMPTY["windows"])

    def ask(state: DataFrame, at: Column) -> DataFrame:
        requests = saved(state.select("rendition", F.get("points", at).alias("p")).select("rendition", "p.*"))
        return state.join(large(holds(requests).select("rendition", F.col("held").alias("answer"))), "rendition")

    first = saved(ask(windows, F.lit(0)))
    whole = first.select("rendition", "window_us", F.col("answer").alias("held"), F.lit(None).cast("long").alias("since_us"), F.lit(1).cast("long").alias("fetches"))
    state = first.where(~F.col("answer") & (F.size("points") > 1)).select("rendition", "points", F.lit(0).alias("low"), (F.size("points") - 1).alias("high"), F.lit(-1).alias("found"), F.lit(1).cast("long").alias("fetches"))
    done = None
    for _ in range(rounds):
        state = saved(state)
        if state.where("low <= high").isEmpty():
            break
        over = state.where("low > high")
        done = over if done is None else done.unionByName(over)
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        state = ask(state.where("low <= high"), mid).select(
            "rendition", "points", F.when(F.col("answer"), F.col("low")).otherwise(mid + 1).alias("low"), F.when(F.col("answer"), mid - 1).otherwise(F.col("high")).alias("high"), F.when(F.col("answer"), mid).otherwise(F.col("found")).alias("found"), (F.col("fetches") + 1).alias("fetches")
        )
    ended = saved(state if done is None else done.unionByName(state))
    told = ended.select("rendition", F.when(F.col("found") < 0, 0).otherwise(span_us(F.col("points"), F.col("found"))).alias("_since"), F.col("fetches").alias("_fetches"))
    return whole.join(told, "rendition", "left").select("rendition", "window_us", "held", F.coalesce("_since", "since_us").alias("since_us"), F.coalesce("_fetches", "fetches").alias("fetches"))
