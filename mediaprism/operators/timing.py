"""Checks of time: adjacent segments, declared against measured, ladders and wall clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.findings import finding, together
from mediaprism.operators.common import Relations, first_by, label, of_stream, place, previous, since_first, unwrapped
from mediaprism.storage import large


def _double(x):
    return x.cast("double")


def continuity(rel: Relations) -> DataFrame:
    """Start against the previous segment's end, on an unwrapped clock; counter breaks."""
    p = rel.parsed.where("kind <> 'text'")
    pair = previous(p, "min_pts", "timescale", "measured_us")
    step = unwrapped(F.col("min_pts") - F.col("prev_min_pts"))
    drift = step * 1_000_000 - F.col("prev_measured_us") * F.col("timescale")
    pair = pair.withColumn("compared", F.col("adjacent") & (F.col("timescale") == F.col("prev_timescale")) & F.col("prev_measured_us").isNotNull()).withColumn("drift", drift)
    off = F.abs("drift") > rel.options.gap_us * F.col("timescale")
    pair = pair.withColumn("off", F.coalesce(F.col("compared") & off, F.lit(False)))
    rule = F.when(F.col("discontinuity"), "declared-discontinuity").when(F.col("drift") > 0, "gap").otherwise("overlap")
    per = finding(pair.where("off"), "continuity", rule, place(), F.when(F.col("discontinuity"), "OK").otherwise("BAD"), _double(F.col("drift")) / (F.col("timescale") * 1000))
    whole = pair.groupBy("rendition").agg(F.sum("cc_errors").alias("breaks"), F.sum(F.col("compared").cast("int")).alias("n"), F.sum((F.col("off") & ~F.col("discontinuity")).cast("int")).alias("bad"))
    counters = finding(whole.where("breaks > 0"), "continuity", "counter", label(), "BAD", F.col("breaks"))
    good = finding(whole.where("breaks = 0 AND n > 0 AND bad = 0"), "continuity", "continuous", label(), "OK", F.col("n"))
    return together(per, counters, good)


def discontinuity(rel: Relations) -> DataFrame:
    """Discontinuities declared where nothing changes, and sequences that differ between renditions."""
    p = rel.parsed.where("kind NOT IN ('text', 'iframe')")
    pair = previous(p, "min_pts", "timescale", "measured_us", "codec", "width", "height")
    drift = unwrapped(F.col("min_pts") - F.col("prev_min_pts")) * 1_000_000 - F.col("prev_measured_us") * F.col("timescale")
    smooth = F.abs(drift) <= rel.options.gap_us * F.col("timescale")
    same = F.col("codec").eqNullSafe(F.col("prev_codec")) & F.col("width").eqNullSafe(F.col("prev_width")) & F.col("height").eqNullSafe(F.col("prev_height"))
    idle = pair.where(F.col("discontinuity") & F.col("adjacent") & smooth & same)
    needless = finding(idle, "discontinuity", "nothing-changes", place(), "BAD", F.col("sequence"))
    # The first rendition of a stream against each other one, by sequence: a group, not a product.
    first = p.groupBy("stream").agg(F.min("rendition").alias("rendition"))
    lead = p.join(first, ["stream", "rendition"]).select("stream", "sequence", F.col("min_pts").alias("lead_pts"), F.col("discontinuity_sequence").alias("lead_ds"), F.col("rendition").alias("lead"))
    both = p.join(large(lead), ["stream", "sequence"]).where((F.col("rendition") != F.col("lead")) & (F.abs(F.col("min_pts") - F.col("lead_pts")) * 1_000_000 <= rel.options.gap_us * F.col("timescale")) & (F.col("discontinuity_sequence") != F.col("lead_ds")))
    apart = finding(both.groupBy("rendition").agg(F.min("sequence").alias("since")), "discontinuity", "sequence-differs", label(), "BAD", F.col("since"))
    declared = p.groupBy("rendition").agg(F.sum(F.col("discontinuity").cast("int")).alias("n")).where("n > 0")
    bad = idle.select("rendition").unionByName(both.select("rendition")).distinct()
    good = finding(declared.join(large(bad), "rendition", "left_anti"), "discontinuity", "declared", label(), "OK", F.col("n"))
    return together(needless, apart, good)


def duration(rel: Relations) -> DataFrame:
    """Declared against measured durations, and against the target."""
    s = rel.of(rel.segments.where("kind <> 'text' AND declared_us > 0"), "target_us")
    long = finding(s.where(F.col("declared_us") > F.col("r_target_us") + rel.options.target_slack_us), "duration", "over-target", place(), "BAD", F.col("declared_us") / 1e6)
    m = s.where("parsed AND measured_us IS NOT NULL").withColumn("pct", _double(F.col("measured_us") - F.col("declared_us")) * 100 / F.col("declared_us"))
    per = m.groupBy("rendition").agg(first_by([-F.abs("pct"), F.col("sequence")], "sequence", "pct").alias("w"), F.sum("measured_us").alias("got"), F.sum("declared_us").alias("said"))
    per = per.select("rendition", "w.sequence", "w.pct", (_double(F.col("got") - F.col("said")) * 100 / F.col("said")).alias("total"))
    tol = rel.options.duration_pct
    worst = finding(per.where(F.abs("pct") > tol), "duration", "segment-drift", place(), "WARN", F.col("pct"))
    total = finding(per, "duration", "total-drift", label(), F.when(F.abs("total") > tol, "WARN").otherwise("OK"), F.col("total"))
    return together(long, worst, total)


def timeline(rel: Relations) -> DataFrame:
    """Measured against declared starts."""
    p = rel.parsed.where("declared_start_us IS NOT NULL").withColumn("drift", F.col("min_pts") * 1_000_000 - F.col("declared_start_us") * F.col("timescale"))
    p = p.withColumn("off", F.abs("drift") > rel.options.gap_us * F.col("timescale"))
    bad = finding(p.where("off"), "timeline", "start", place(), "BAD", _double(F.col("drift")) / (F.col("timescale") * 1000))
    good = p.groupBy("rendition").agg(F.max("off").alias("any"), F.count("*").alias("n")).where("NOT any")
    return together(bad, finding(good, "timeline", "agrees", label(), "OK", F.col("n")))


def alignment(rel: Relations) -> DataFrame:
    """Spread of starts over a stream's video ladder, by period and sequence."""
    g = rel.parsed.where("kind = 'video'").groupBy("stream", "period", "sequence").agg(F.count("*").alias("n"), (F.max("min_pts") - F.min("min_pts")).alias("spread"), F.max("timescale").alias("ts")).where("n > 1")
    g = g.withColumn("off", F.col("spread") * 1_000_000 > rel.options.gap_us * F.col("ts"))
    bad = finding(g.where("off"), "alignment", "spread", of_stream("p", F.col("period").cast("string"), F.lit("/"), F.col("sequence").cast("string")), "BAD", _double(F.col("spread")) / (F.col("ts") / 1000))
    good = g.groupBy("stream").agg(F.count("*").alias("n"), F.max("off").alias("any")).where("NOT any")
    return together(bad, finding(good, "alignment", "aligned", of_stream("ladder"), "OK", F.col("n")))


def pdt(rel: Relations) -> DataFrame:
    """Wall clock against media clock, along each rendition and across the ladder."""
    p = rel.parsed.where("kind <> 'text' AND pdt_us IS NOT NULL")
    pair = previous(p, "pdt_us", "min_pts").where("adjacent")
    clock = F.col("pdt_us") - F.col("prev_pdt_us")
    pair = pair.withColumn("clock", clock).withColumn("off_ticks", clock * F.col("timescale") - (F.col("min_pts") - F.col("prev_min_pts")) * 1_000_000)
    back = pair.where("clock <= 0").groupBy("rendition").agg(F.min("sequence").alias("sequence"), F.count("*").alias("n"))
    backwards = finding(back, "pdt", "backwards", place(), "BAD", F.col("n"))
    drift = pair.where(~F.col("discontinuity") & (F.abs("off_ticks") > rel.options.gap_us * F.col("timescale")))
    worst = drift.groupBy("rendition").agg(first_by([-F.abs("off_ticks"), F.col("sequence")], "sequence", "off_ticks", "timescale").alias("w")).select("rendition", "w.*")
    drifting = finding(worst, "pdt", "drift", place(), "BAD", _double(F.col("off_ticks")) / (F.col("timescale") * 1000))
    bad = back.select("rendition").unionByName(worst.select("rendition")).distinct()
    good = finding(pair.groupBy("rendition").agg(F.count("*").alias("n")).join(large(bad), "rendition", "left_anti"), "pdt", "agrees", label(), "OK", F.col("n"))
    v = p.where("kind = 'video'").withColumn("origin", F.col("pdt_us") - F.expr("min_pts * 1000000 div timescale"))
    g = v.groupBy("stream", "sequence").agg(F.count("*").alias("n"), (F.max("min_pts") - F.min("min_pts")).alias("media"), (F.max("origin") - F.min("origin")).alias("spread"), F.max("timescale").alias("ts"))
    g = g.where((F.col("n") > 1) & (F.col("media") * 1_000_000 <= rel.options.gap_us * F.col("ts")) & (F.col("spread") > rel.options.gap_us))
    return together(backwards, drifting, good, finding(g, "pdt", "ladder", of_stream("seq", F.col("sequence").cast("string")), "BAD", F.col("spread") / 1000))


def parts(rel: Relations) -> DataFrame:
    """Low-latency parts: readable, independent where declared, contiguous, on their segment's ends, within the part target."""
    x = rel.of(rel.parts, "part_target_us")
    w = Window.partitionBy("rendition", "sequence").orderBy("idx")
    ok = x.where("parsed")
    pair = ok.select("*", F.lag("idx").over(w).alias("pi"), F.lag("min_pts").over(w).alias("pp"), F.lag("declared_us").over(w).alias("pd"))
    drift = unwrapped(F.col("min_pts") - F.col("pp")) * 1_000_000 - F.col("pd") * F.col("timescale")
    at = F.concat_ws("/", label(), F.col("sequence").cast("string"), F.col("idx").cast("string"))
    # The first and the last part of a segment against the segment itself, where all parts between are there.
    ends = ok.groupBy("rendition", "sequence").agg(first_by([F.col("idx")], "idx", "min_pts").alias("a"), first_by([-F.col("idx")], "idx", "min_pts", "declared_us").alias("z"), F.count("*").alias("n"), F.max("timescale").alias("scale"))
    ends = ends.join(large(rel.parsed.select("rendition", "sequence", F.col("min_pts").alias("from"), "measured_us")), ["rendition", "sequence"])
    early = unwrapped(F.col("a.min_pts") - F.col("from")) * 1_000_000
    late = unwrapped(F.col("z.min_pts") - F.col("from")) * 1_000_000 + (F.col("z.declared_us") - F.col("measured_us")) * F.col("scale")
    tol = rel.options.gap_us * F.col("scale")
    whole = ends.where("a.idx = 0")
    closed = whole.where("n = z.idx + 1 AND measured_us IS NOT NULL")
    return together(
        finding(x.where("NOT parsed"), "parts", "unreadable", at, "BAD"),
        finding(ok.where("independent AND NOT opens_keyframe"), "parts", "not-independent", at, "BAD"),
        finding(pair.where((F.col("pi") == F.col("idx") - 1) & (F.abs(drift) > rel.options.gap_us * F.col("timescale"))), "parts", "drift", at, "BAD", _double(drift) / (F.col("timescale") * 1000)),
        finding(whole.where(F.abs(early) > tol), "parts", "segment-start", place(), "BAD", _double(early) / (F.col("scale") * 1000)),
        finding(closed.where(F.abs(late) > tol), "parts", "segment-end", place(), "BAD", _double(late) / (F.col("scale") * 1000)),
        finding(ok.where(F.col("declared_us") > F.col("r_part_target_us") + rel.options.gap_us), "parts", "over-target", at, "BAD", F.col("declared_us") / 1e6),
    )


def subtitles(rel: Relations) -> DataFrame:
    """Cues against the span of their segment: the running declared time of the rendition's segments, those not read among them, from the stream's first video clock on."""
    w = Window.partitionBy("rendition").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    origin = rel.parsed.where("kind = 'video'").groupBy("stream").agg(F.min(F.floor(F.col("min_pts") * 1_000_000 / F.col("timescale"))).alias("origin"))
    s = rel.segments.where("kind = 'text'").withColumn("start", F.coalesce(F.sum("declared_us").over(w), F.lit(0))).where("parsed")
    s = s.join(origin, "stream", "left").withColumn("since", F.coalesce("origin", F.lit(0)) + F.col("start")).select("rendition", "sequence", "declared_us", "since", "mapped", "origin")
    c = s.join(large(rel.cues), ["rendition", "sequence"])
    tol = rel.options.gap_us
    c = c.withColumn("off", (F.col("begin_us") < F.col("since") - tol) | (F.col("end_us") > F.col("since") + F.col("declared_us") + tol))
    worst = c.where("off").groupBy("rendition", "sequence").agg(F.min(F.col("begin_us") - F.col("since")).alias("by"))
    bad = finding(worst, "subtitles", "outside", place(), "BAD", F.col("by") / 1e6)
    n = c.groupBy("rendition").agg(F.count("*").alias("n"), F.max("off").alias("any"))
    g = s.groupBy("rendition").agg(F.max("mapped").alias("mapped"), F.max("origin").alias("origin")).join(large(n), "rendition", "left").where("NOT coalesce(any, false)")
    rule = F.when(F.col("n").isNull(), "no-cues").when(~F.col("mapped"), "no-map").when(F.col("origin").isNull(), "no-origin").otherwise("inside")
    return together(bad, finding(g, "subtitles", rule, label(), F.when(F.col("n").isNull() | ~F.col("mapped"), "WARN").otherwise("OK"), F.coalesce("n", F.lit(0))))


def adbreak(rel: Relations) -> DataFrame:
    """Splice points and declared breaks against the nearest measured segment boundary, within the span sampled.

    Boundaries are the measured starts of video segments and the end of the last. Boundaries and points are ordered together,
    and each point sees the last boundary before and the first after it: one sort by rendition in place of a join of
    all points with all boundaries.
    """
    v = rel.parsed.where("kind = 'video'")
    span = v.groupBy("rendition").agg(F.min_by("min_pts", "sequence").alias("first"), first_by([-F.col("sequence")], "min_pts", "measured_us", "timescale").alias("last"), F.max("timescale").alias("scale"), first_by([F.col("pdt_us").isNull(), F.col("sequence")], "pdt_us", "min_pts").alias("anchor"))
    starts = v.select("rendition", "sequence", "min_pts").join(large(span.select("rendition", "first")), "rendition").select("rendition", since_first(F.col("min_pts"), F.col("first")).alias("at"))
    close = span.where("last.measured_us IS NOT NULL").select("rendition", (since_first(F.col("last.min_pts"), F.col("first")) + F.floor(F.col("last.measured_us") * F.col("last.timescale") / 1_000_000)).alias("at"))
    edges = starts.unionByName(close)
    b = rel.breaks.join(large(span), "rendition").join(large(v.select("rendition", F.col("sequence").alias("at_sequence"), F.col("min_pts").alias("sequence_pts"))), ["rendition", "at_sequence"], "left")
    by_clock = F.col("anchor.min_pts") + F.floor((F.col("clock_us") - F.col("anchor.pdt_us")) * F.col("scale") / 1_000_000)
    by_media = F.floor(_double(F.col("media_us")) * F.col("scale") / 1_000_000)
    declared = b.select("rendition", F.concat(label(), F.lit("@b"), F.col("break").cast("string")).alias("name"), F.lit("break").alias("what"), since_first(F.coalesce("media_pts", by_media, "sequence_pts", by_clock), F.col("first")).alias("at"))
    spliced = rel.splices.join(large(span.select("rendition", "first")), "rendition").select("rendition", F.concat(label(), F.lit("@"), F.col("splice").cast("string")).alias("name"), F.lit("splice").alias("what"), since_first(F.col("pts"), F.col("first")).alias("at"))
    points = declared.unionByName(spliced)
    none = F.lit(None).cast("string")
    both = edges.select("rendition", "at", F.col("at").alias("edge"), none.alias("name"), none.alias("what")).unionByName(points.where("at IS NOT NULL").select("rendition", "at", F.lit(None).cast("long").alias("edge"), "name", "what"))
    w = Window.partitionBy("rendition").orderBy("at", F.col("edge").isNull())
    both = both.select("*", F.last("edge", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first("edge", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("after"))
    both = both.join(large(span.select("rendition", "scale")), "rendition")
    tol = F.lit(rel.options.gap_us) * F.col("scale")
    x = both.where("name IS NOT NULL").withColumn("away", F.least(F.col("at") - F.col("before"), F.col("after") - F.col("at")))
    # Inside the span sampled, or no further than the tolerance beyond it.
    x = x.where((F.col("before").isNotNull() & F.col("after").isNotNull()) | (F.col("away") * 1_000_000 <= tol))
    ms = lambda c: _double(c) * 1000 / F.col("scale")
    off = F.col("away") * 1_000_000 > tol
    rule = F.concat("what", F.when(off, "-off-boundary").otherwise("-on-boundary"))
    told = rel.breaks.where("section_pts IS NOT NULL").join(large(rel.splices.where("pts IS NOT NULL").groupBy("rendition", "event").agg(F.min_by("pts", "splice").alias("pts"))), ["rendition", "event"]).join(large(span.select("rendition", "scale")), "rendition")
    # A section's clock has 90,000 ticks a second, the media's as many as it states.
    told = told.withColumn("off", unwrapped(F.floor(_double(F.col("section_pts")) * F.col("scale") / 90_000) - F.col("pts"))).where(F.abs("off") * 1_000_000 > tol)
    untimed = points.where("at IS NULL").groupBy("rendition").agg(F.count("*").alias("n"))
    return together(
        finding(x, "adbreak", rule, F.col("name"), F.when(off, "BAD").otherwise("OK"), ms(F.col("away"))),
        finding(told, "adbreak", "section-differs", F.concat(label(), F.lit("@b"), F.col("break").cast("string")), "BAD", ms(F.col("off"))),
        finding(untimed, "adbreak", "untimed", label(), "OK", F.col("n")),
    )


def period(rel: Relations) -> DataFrame:
    """Period boundaries: media drift against the first period, codecs and sizes that change."""
    p = rel.parsed.where("declared_start_us IS NOT NULL").withColumn("drift", F.col("min_pts") * 1_000_000 - F.col("declared_start_us") * F.col("timescale"))
    per = p.groupBy("stream", "rendition", "period").agg(first_by([F.abs("drift"), F.col("sequence")], "drift", "timescale").alias("m"))
    whole = per.groupBy("stream", "period").agg(first_by([-F.abs("m.drift"), F.col("rendition")], "m").alias("w")).select("stream", "period", "w.m.drift", "w.m.timescale")
    of_one = Window.partitionBy("stream")
    x = whole.select("*", F.min_by("drift", "period").over(of_one).alias("base"), F.min("period").over(of_one).alias("first")).where("period <> first").withColumn("ms", _double(F.col("drift") - F.col("base")) / (F.col("timescale") * 1000))
    x = x.join(rel.renditions.groupBy("stream").agg(F.max("target_us").alias("target")), "stream")
    late, early = F.lit(rel.options.period_late_us / 1000), (F.col("target") + rel.options.period_late_us) / 1000
    at = of_stream("p", F.col("period").cast("string"))
    drifting = finding(x, "period", F.when((F.col("ms") > late) | (F.col("ms") < -early), "drift").otherwise("placed"), at, F.when((F.col("ms") > late) | (F.col("ms") < -early), "BAD").otherwise("OK"), F.col("ms"))
    lists = rel.parsed.where("kind = 'video'").groupBy("rendition", "period").agg(F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))), ",").alias("sizes"))
    w = Window.partitionBy("rendition").orderBy("period")
    moved = lists.select("*", F.lag("codecs").over(w).alias("pc"), F.lag("sizes").over(w).alias("ps"))
    at = F.concat(label(), F.lit("/p"), F.col("period").cast("string"))
    return together(drifting, finding(moved.where("pc <> codecs"), "period", "codecs-change", at, "BAD"), finding(moved.where("ps <> sizes"), "period", "sizes-change", at, "WARN"))


def dvr(rel: Relations) -> DataFrame:
    """The oldest segment of a live window must still be there; where it is not, the span that was found to be. ``retention`` measures it."""
    held = F.col("held")
    return finding(rel.windows, "dvr", F.when(held, "held").otherwise("gone"), label(), F.when(held, "OK").otherwise("BAD"), F.when(held, F.col("window_us")).otherwise(F.col("since_us")) / 1e6)


def availability(rel: Relations) -> DataFrame:
    """Live streams whose manifest goes by the clock: the clock itself, segments that it promises and that are not there (a trailing run), and one that is there too early."""
    s = rel.of(rel.segments, "live", "format").where("r_live AND r_format = 'dash'")
    g = s.groupBy("rendition").agg(F.max("sequence").alias("newest"), F.coalesce(F.max(F.when(F.col("fetched"), F.col("sequence"))), F.min("sequence") - 1).alias("there"))
    g = g.withColumn("run", F.col("newest") - F.col("there"))
    streams = rel.renditions.where("live AND format = 'dash'").select("stream").distinct().join(rel.clocks, "stream", "left")
    off = F.abs("skew_us") > rel.options.clock_skew_us
    rule = F.when(off, "clock-off").when(F.col("skew_us").isNotNull(), "clock-agrees").when((F.col("sources") > 0) & ~F.col("spoken"), "clock-unsupported").when(F.col("sources") > 0, "clock-silent").otherwise("no-clock")
    early = rel.ahead.where("served").join(large(rel.renditions.select("rendition")), "rendition", "left_semi")
    return together(
        finding(g, "availability", F.when(F.col("run") > 0, "newest-missing").otherwise("there"), label(), F.when(F.col("run") > 0, "BAD").otherwise("OK"), F.col("run")),
        finding(streams, "availability", rule, of_stream("clock"), F.when(off, "WARN").otherwise("OK"), F.col("skew_us") / 1e6),
        finding(early, "availability", "next-served", label(), "WARN"),
    )


def watch(rel: Relations) -> DataFrame:
    """A polled live edge: empty, never moved, stalled, went backwards, or published slower or faster than time passes.

    The previous newest segment is looked up in the next list: what follows it was published meanwhile; if it scrolled out, that is not known.
    An edge that stood earlier in the previous list went backwards. The rate is judged over four segments at least, and may be off by one and a fifth of the time.
    """
    w = Window.partitionBy("rendition").orderBy("poll")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    o = rel.observations.where("NOT failed").withColumn("newest", F.try_element_at("uris", F.lit(-1)))
    o = o.select("*", F.lag("uris").over(w).alias("was"), F.lag("newest").over(w).alias("last"), F.row_number().over(w).alias("nth"), F.coalesce(F.last("newest", True).over(before), F.lit("")).alias("shown"))
    at = F.array_position("uris", F.col("last"))
    published = F.when(at > 0, F.aggregate(F.slice("durations_us", (at + 1).cast("int"), F.size("uris")), F.lit(0).cast("long"), lambda a, b: a + b))
    here, there = F.array_position("was", F.col("newest")), F.array_position("was", F.col("last"))
    back = F.coalesce((F.col("newest") != F.col("last")) & (here > 0) & (here < there), F.lit(False))
    moved = (F.col("nth") > 1) & F.col("newest").isNotNull() & (F.col("newest") != F.col("shown"))
    o = o.select("*", moved.alias("moved"), published.alias("published"), back.alias("back")).withColumn("moved_us", F.when(F.col("moved"), F.col("observed_us")))
    since = F.coalesce(F.last("moved_us", True).over(before), F.min("observed_us").over(Window.partitionBy("rendition")))
    o = o.withColumn("gap", F.col("observed_us") - since).withColumn("one", F.when(F.col("published").isNotNull(), F.array_max("durations_us")))
    g = o.groupBy("rendition").agg(
        F.count("*").alias("looks"), F.count("newest").alias("filled"), F.count("moved_us").alias("advances"), F.max("gap").alias("stall"), F.max("back").alias("back"), F.max("target_us").alias("target"), (F.max("observed_us") - F.min("observed_us")).alias("passed"), F.sum("published").alias("media"), F.max("one").alias("one"),
    )
    ahead = F.col("media") - F.col("passed")
    judged = g.where("looks > 1 AND advances > 0")
    rated = judged.where("NOT back AND one > 0 AND passed >= 4 * one").where(F.abs(ahead) > F.col("one") + F.col("passed") / 5)
    failed = rel.observations.groupBy("rendition").agg(F.sum(F.col("failed").cast("int")).alias("n"), F.count("*").alias("polls")).where("n > 0")
    stalled = F.col("stall") > F.col("target") * rel.options.stall_tolerance
    rule = F.when(F.col("looks") == 1, "one-look").when(F.col("filled") == 0, "empty").when(F.col("advances") == 0, "never-advanced").when(F.col("target").isNull(), "no-interval").when(stalled, "stalled").otherwise("advancing")
    g = g.withColumn("rule", rule)
    whole = F.col("rule").isin("empty", "never-advanced")
    return together(
        finding(g, "watch", F.col("rule"), label(), F.when(whole | (F.col("rule") == "stalled"), "BAD").otherwise("OK"), F.when(whole, F.col("passed")).when(F.col("rule") != "one-look", F.col("stall")) / 1e6),
        finding(judged.where("back"), "watch", "backwards", label(), "BAD"),
        finding(rated, "watch", F.when(ahead < 0, "behind").otherwise("ahead"), label(), F.when(ahead < 0, "BAD").otherwise("WARN"), F.abs(ahead) / 1e6),
        finding(failed, "watch", F.when(F.col("n") == F.col("polls"), "all-failed").otherwise("poll-failed"), label(), "ERROR", F.col("n")),
    )
