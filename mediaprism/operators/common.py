"""What checks share: their input, labels, unwrapped clocks and medians."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.options import Options
from mediaprism.storage import large


#: The relations that a run may lack, by name.
EMPTY = {
    "parts": "rendition long, sequence long, idx long, declared_us long, min_pts long, timescale long, parsed boolean, independent boolean, opens_keyframe boolean",
    "splices": "splice long, rendition long, event long, pts long",
    "breaks": "break long, rendition long, event long, media_pts long, media_us long, at_sequence long, clock_us long, section_pts long",
    "cues": "rendition long, sequence long, begin_us long, end_us long",
    "probes": "host string, status long, asked_bytes long, got_bytes long, failed boolean",
    "observations": "rendition long, poll long, observed_us long, uris array<string>, durations_us array<long>, target_us long, failed boolean",
    "edges": "rendition long, sequence long, edge string, missing boolean, digest string",
    "clocks": "stream long, sources long, spoken boolean, now_us long, skew_us long",
    "ahead": "rendition long, served boolean",
    "windows": "rendition long, window_us long, held boolean, since_us long, fetches long",
}


@dataclass(frozen=True)
class Relations:
    """What one or many streams were found to hold. ``stream`` is a column of segments and renditions, whose ``rendition`` is unique over all streams; what compares
    renditions does so within a stream. ``all_renditions`` includes those that failed; the others leave them out. A relation that is not given is empty.
    """

    all_segments: DataFrame
    all_renditions: DataFrame
    parts: DataFrame | None = None
    splices: DataFrame | None = None
    breaks: DataFrame | None = None
    cues: DataFrame | None = None
    probes: DataFrame | None = None
    observations: DataFrame | None = None
    edges: DataFrame | None = None
    windows: DataFrame | None = None
    clocks: DataFrame | None = None
    ahead: DataFrame | None = None
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        spark = self.all_segments.sparkSession
        for name, schema in EMPTY.items():
            if getattr(self, name) is None:
                object.__setattr__(self, name, spark.createDataFrame([], schema))

    @cached_property
    def renditions(self) -> DataFrame:
        return self.all_renditions.where(~F.col("failed"))

    @cached_property
    def segments(self) -> DataFrame:
        return self.all_segments.join(large(self.renditions.select("rendition")), "rendition", "left_semi")

    @cached_property
    def parsed(self) -> DataFrame:
        return self.segments.where("parsed")

    def of(self, segments: DataFrame, *columns: str, with_init: bool = False) -> DataFrame:
        """Segments with columns of their rendition, prefixed ``r_``; renditions whose init failed may be left out."""
        r = self.renditions.where(~F.col("init_failed")) if with_init else self.renditions
        return segments.join(large(r.select("rendition", *[F.col(c).alias(f"r_{c}") for c in columns])), "rendition")


def label(rendition: str = "rendition") -> Column:
    return F.concat(F.lit("r"), F.col(rendition).cast("string"))


def of_stream(*tail: Column | str) -> Column:
    """A target that belongs to a stream as a whole."""
    return F.concat(F.lit("s"), F.col("stream").cast("string"), F.lit("/"), *[t if isinstance(t, Column) else F.lit(t) for t in tail])


def place(rendition: str = "rendition", sequence: str = "sequence") -> Column:
    return F.concat_ws("/", label(rendition), F.col(sequence).cast("string"))


def unwrapped(difference: Column) -> Column:
    """A difference of two 33-bit clocks, folded into half a turn either way."""
    half, turn = 1 << 32, 1 << 33
    return F.when(difference > half, difference - turn).when(difference < -half, difference + turn).otherwise(difference)


def since_first(pts: Column, first: Column) -> Column:
    """A clock from a rendition's first one on, so that it does not turn over inside what is looked at."""
    return unwrapped(pts - first)


def upper_median(value: Column) -> Column:
    """The upper middle element; never interpolated. Nulls do not count."""
    v = F.sort_array(F.collect_list(value))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def previous(segments: DataFrame, *columns: str) -> DataFrame:
    """Each segment with columns of the one before, as ``prev_*``, where that is adjacent; null where the chain breaks."""
    w = Window.partitionBy("rendition").orderBy("sequence")
    lagged = segments.select("*", F.lag("sequence").over(w).alias("_seq"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    adjacent = F.col("_seq") == F.col("sequence") - 1
    return lagged.select(*segments.columns, adjacent.alias("adjacent"), *[F.when(adjacent, F.col(f"prev_{c}")).alias(f"prev_{c}") for c in columns]).na.fill(False, ["adjacent"])


def first_by(order: list[Column], *columns: str) -> Column:
    """The columns, as a struct, of the row that comes first in ``order``."""
    return F.min_by(F.struct(*columns), F.struct(*order))
