"""All checks by name, and runs of several of them over the same relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.operators import content, timing
from mediaprism.operators.common import EMPTY, Relations
from mediaprism.operators.retention import measure, windows_of
from mediaprism.plans import relations as R
from mediaprism.storage import saved, saved_each

CHECKS: dict[str, Callable[[Relations], DataFrame]] = {
    name: getattr(module, name)
    for module, names in (
        (content, "manifest fetch init container bitrate resolution tracks keyframe framerate audio captions encryption ladder pop cache byterange codecstring videorange clear scheme drm iframe profile"),
        (timing, "continuity duration timeline subtitles adbreak alignment dvr availability pdt parts watch period discontinuity"),
    )
    for name in names.split()
}


INPUTS = ("all_segments", "all_renditions", *EMPTY)


def register(name: str, check: Callable[[Relations], DataFrame]) -> None:
    """Add a check of one's own; it takes relations and returns findings."""
    CHECKS[name] = check


def load(spark: SparkSession, sf_dir: str, windows: bool = False) -> Relations:
    """The relations of a run, projected from the tables in a folder. ``windows``: measure what live windows hold, in rounds of jobs."""
    of = lambda sql: R.relation(spark, sf_dir, sql)
    rel = Relations(of(R.SEGMENTS), of(R.RENDITIONS), of(R.PARTS), of(R.SPLICES), of(R.BREAKS), of(R.CUES), of(R.PROBES), of(R.OBSERVATIONS), of(R.EDGES), clocks=of(R.CLOCKS), ahead=of(R.AHEAD))
    if not windows:
        return rel
    kept = rel.segments.select("rendition", "sequence", (F.col("kept") & F.col("parsed")).alias("held"))
    return replace(rel, windows=measure(windows_of(rel.all_renditions, rel.segments), lambda asked: asked.join(kept, ["rendition", "sequence"])))


def shared(relations: Relations) -> Relations:
    """The relations written once, so that checks which run together compute none of them twice and nothing has to be released."""
    kept = {f: saved(getattr(relations, f)) for f in INPUTS if getattr(relations, f) is not None}
    return replace(relations, **kept)


def run_checks(relations: Relations, names: list[str] | None = None) -> DataFrame:
    """The findings of the checks named, or of all; each check's are written by a job of its own, as one plan of them all outgrows the driver."""
    return saved_each(*(CHECKS[n](relations) for n in (names or CHECKS)))
