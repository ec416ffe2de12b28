"""From manifests and bodies to the relations that the checks read, many streams at once.

A manifest of either kind becomes a ``Listing``: its renditions and the segments they name. Renditions are sampled, their segments
fetched (``Fetch``: a corpus table, or HTTP), decrypted where a key is there, parsed once, and the result is written without bodies.
What is small, inits and keys, is joined to the requests before any body is there, and bodies cross one exchange, by URI, into the Arrow stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.functions import text
from mediaprism.media import stage
from mediaprism.operators import clock
from mediaprism.operators.common import Relations
from mediaprism.operators.retention import measure, windows_of
from mediaprism.options import Options
from mediaprism.sources import dash, hls, indexed
from mediaprism.sources.fetch import from_corpus
from mediaprism.storage import large, saved, spread

#: Takes requests (uri, offset, length; further columns stay) and adds status, headers, body, truncated and error.
Fetch = Callable[[DataFrame], DataFrame]

#: Renditions of one manifest are numbered from here on; one of more raises.
_ROOM = 100_000
#: What a probe for range support asks for at most, and the newest segments whose parts are read.
PROBE_BYTES, PART_SEGMENTS = 1024, 3
# Headers that name a cache's answer, in the order they are asked.
CACHE_HEADERS = ("x-cache", "cf-cache-status", "x-cache-status", "x-proxy-cache", "cdn-cache")


@dataclass(frozen=True)
class Listing:
    """What manifests name. ``segments``: stream, rendition, kind, period, sequence, uri, offset, length, init_uri, init_offset, init_length, key_uri, key_iv, key_method, declared_us, declared_start_us, pdt_us, discontinuity, discontinuity_sequence, live.
    ``parts``: rendition, sequence, idx, uri, offset, length, declared_us, independent, and their segment's init and key columns."""

    renditions: DataFrame
    segments: DataFrame
    breaks: DataFrame | None = None
    parts: DataFrame | None = None
    clocks: DataFrame | None = None
    ahead: DataFrame | None = None


def evenly(renditions: DataFrame, k: int | None) -> DataFrame:
    """Of each manifest's video renditions k by bandwidth, the extremes among them, evenly between; of one the best; others stay."""
    if k is None:
        return renditions
    w = Window.partitionBy("manifest_id", "kind").orderBy("bandwidth", "n")
    ranked = renditions.withColumns({"_rank": F.row_number().over(w) - 1, "_of": F.count("*").over(Window.partitionBy("manifest_id", "kind"))})
    if k == 1:
        keep = F.col("_rank") == F.col("_of") - 1
    else:
        step = (F.col("_of") - 1) / F.lit(float(k - 1))
        keep = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * step + 0.5).cast("int")), F.col("_rank"))
    return ranked.where((F.col("kind") != "video") | (F.col("_of") <= k) | keep).drop("_rank", "_of")


def first_or_last(segments: DataFrame, n: int | None, start: str = "auto") -> DataFrame:
    """The first n segments of a rendition that has ended, the last n of a live one; or by ``start`` (``edge``, ``start``)."""
    if n is None:
        return segments
    up, down = (F.row_number().over(Window.partitionBy("rendition").orderBy(o)) for o in (F.col("sequence"), F.desc("sequence")))
    edge = F.col("live") if start == "auto" else F.lit(start == "edge")
    return segments.withColumns({"_up": up, "_down": down}).where(F.when(edge, F.col("_down") <= n).otherwise(F.col("_up") <= n)).drop("_up", "_down")


def newest_with_parts(parts: DataFrame, n: int) -> DataFrame:
    """Parts of the n newest segments that have any."""
    rank = F.dense_rank().over(Window.partitionBy("rendition").orderBy(F.desc("sequence")))
    return parts.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def cache_columns(headers: Column) -> dict[str, Column]:
    """What a response says about caching: HIT, MISS or nothing, and whether it forbids it."""
    said = F.upper(F.coalesce(text.header(headers, *CACHE_HEADERS), F.lit("")))
    control = F.lower(F.coalesce(text.header(headers, "cache-control"), F.lit("")))
    return {"cache_status": F.when(said.contains("HIT"), "HIT").when(said.contains("MISS"), "MISS"), "uncacheable": control.rlike("no-store|no-cache|private"), "accepts_ranges": F.lower(F.coalesce(text.header(headers, "accept-ranges"), F.lit(""))) == "bytes"}


def _numbered(by: Column) -> Column:
    """A rendition's number over all streams."""
    nth = F.dense_rank().over(Window.partitionBy("manifest_id").orderBy(by))
    return F.col("manifest_id") * _ROOM + F.when(nth < _ROOM, nth).otherwise(F.raise_error(F.format_string("manifest %d has more renditions than can be numbered", "manifest_id")).cast("int"))


def _us(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("long")


def hls_listing(manifests: DataFrame, fetch: Fetch, rungs: int | None = None) -> Listing:
    """Of master playlists, or media playlists given directly (manifest_id, url, body)."""
    none = F.lit(None).cast("long")
    heads = hls.playlists(manifests).select("manifest_id", "master")
    masters = manifests.join(heads.where("master"), "manifest_id", "left_semi")
    r = evenly(hls.with_captions(hls.renditions(masters), masters), rungs).withColumn("rendition", _numbered(F.col("n")))
    alone = manifests.join(heads.where("NOT master"), "manifest_id", "left_semi")
    columns = {"n": F.lit(0), "kind": F.lit("video"), "uri": F.col("url"), "bandwidth": F.lit(0).cast("long"), "codecs": F.lit(""), "rendition": F.col("manifest_id") * _ROOM + 1}
    r = saved(r.unionByName(alone.select("manifest_id", *[v.alias(k) for k, v in columns.items()]), allowMissingColumns=True).drop("url", "body"))
    given = alone.select(F.col("manifest_id").alias("stream"), (F.col("manifest_id") * _ROOM + 1).alias("manifest_id"), "url", F.col("body").cast("string").alias("body"))
    asked = saved(r.join(alone.select("manifest_id"), "manifest_id", "left_anti").select(F.col("manifest_id").alias("stream"), F.col("rendition").alias("manifest_id"), "uri", none.alias("offset"), none.alias("length")))
    read = fetch(asked).where("error IS NULL").select("stream", "manifest_id", F.col("uri").alias("url"), F.col("body").cast("string").alias("body"))
    lists = saved(read.unionByName(given))
    owner = r.select("rendition", F.col("manifest_id").alias("stream"), "kind")

    s = hls.segments(lists).withColumnRenamed("manifest_id", "rendition").join(large(owner), "rendition")
    segments = s.select(
        "stream", "rendition", "kind", F.lit(0).alias("period"), "sequence", "uri", F.col("byte_range.offset").alias("offset"), F.col("byte_range.length").alias("length"), "init_uri", F.col("init_range.offset").alias("init_offset"), F.col("init_range.length").alias("init_length"), "key_uri", "key_iv", "key_method",
        _us(F.col("duration")).alias("declared_us"), none.alias("declared_start_us"), F.unix_micros("pdt").alias("pdt_us"), "discontinuity", "discontinuity_sequence", "live",
    )
    segments = saved(segments)

    keys = hls.key_systems(lists).select(F.col("manifest_id").alias("rendition"), F.col("systems").alias("own"), "scheme")
    session = hls.key_systems(masters).select("manifest_id", F.col("systems").alias("shared"))
    head = hls.playlists(lists).select(F.col("manifest_id").alias("rendition"), "live", "target_duration", "part_target")
    empty = F.array().cast("array<string>")
    # Entries of groups and playlists given directly have no place for a bandwidth, so none is stated rather than zero.
    renditions = r.join(large(head), "rendition", "left").join(large(keys), "rendition", "left").join(session, "manifest_id", "left").select(
        F.col("manifest_id").alias("stream"), "rendition", "kind", F.lit(0).alias("period"), F.when(F.col("n").eqNullSafe(0) | F.col("group_id").isNotNull(), F.nullif(F.col("bandwidth"), F.lit(0))).otherwise(F.col("bandwidth")).alias("bandwidth"), F.nullif(F.col("width"), F.lit(0)).cast("long").alias("width"), F.nullif(F.col("height"), F.lit(0)).cast("long").alias("height"), "codecs", F.round(F.col("frame_rate") * 1000).cast("long").alias("fps_milli"),
        none.alias("sample_rate"), F.nullif(F.col("channels"), F.lit(0)).cast("long").alias("channels"), F.coalesce("caption_ids", empty).alias("captions"), F.coalesce("captions_none", F.lit(False)).alias("captions_none"), "audio_group", "group_id", F.col("live").isNull().alias("failed"),
        none.alias("transfer"), "video_range", "scheme", F.array_sort(F.array_union(F.coalesce("own", empty), F.coalesce("shared", empty))).alias("drm"), F.coalesce("live", F.lit(False)).alias("live"), _us(F.col("target_duration")).alias("target_us"), _us(F.col("part_target")).alias("part_target_us"), F.lit("hls").alias("format"),
    )

    b = hls.ad_breaks(lists)
    b = b.select("*", F.when(F.col("section").isNotNull(), stage.section_told("section")).alias("told"))
    breaks = saved(b.select(F.xxhash64("manifest_id", "id", "at_sequence", "start").alias("break"), F.col("manifest_id").alias("rendition"), F.col("told.event").alias("event"), none.alias("media_pts"), none.alias("media_us"), "at_sequence", F.unix_micros("start").alias("clock_us"), F.col("told.pts").alias("section_pts")))
    p = newest_with_parts(hls.parts(lists).withColumnRenamed("manifest_id", "rendition"), PART_SEGMENTS).where("NOT gap")
    carried = ("init_uri", "init_offset", "init_length", "key_uri", "key_iv", "key_method")
    # Parts carry what their segment does; those of a segment that is not listed yet, what the newest does.
    of_segment = segments.select("rendition", "sequence", *carried)
    newest = segments.groupBy("rendition").agg(F.max_by(F.struct(*carried), "sequence").alias("x")).select("rendition", *[F.col(f"x.{c}").alias(f"_{c}") for c in carried])
    p = p.join(large(of_segment), ["rendition", "sequence"], "left").join(large(newest), "rendition", "left")
    parts = p.select("rendition", "sequence", F.col("idx").cast("long").alias("idx"), "uri", F.col("byte_range.offset").alias("offset"), F.col("byte_range.length").alias("length"), _us(F.col("duration")).alias("declared_us"), "independent", *[F.coalesce(c, f"_{c}").alias(c) for c in carried])
    return Listing(saved(renditions), segments, breaks, saved(parts))


def dash_listing(manifests: DataFrame, fetch: Fetch, rungs: int | None = None, now: float | None = None) -> Listing:
    """Of DASH manifests (manifest_id, url, body). A representation that goes on in later periods, by its id, is one rendition."""
    none, text_none = F.lit(None).cast("long"), F.lit(None).cast("string")
    key = ["manifest_id", "period_index", "set_index", "rep_index"]
    clocks = clock.resolve(dash.time_sources(manifests), fetch)
    told = clocks.where("now_us IS NOT NULL").select(F.col("stream").alias("manifest_id"), F.col("now_us").alias("clock_us"))
    reps = saved(dash.representations(manifests).join(told, "manifest_id", "left"))
    reps = evenly(reps.withColumn("n", F.lit(0)), rungs).withColumn("rendition", _numbered(F.coalesce("rep_id", F.concat_ws(":", "set_index", "rep_index"))))
    reps = saved(reps)
    owner = reps.select(*key, "rendition", F.col("type").alias("_type"), "scheme", "period_start", F.col("timescale").alias("_scale"), F.col("presentation_time_offset").alias("pto"))
    named = dash.segments(manifests, now, found=reps).select(*key, "kind", "sequence", "uri", "init_uri", "duration", "range_offset", "range_length", "media_start", none.alias("init_offset"), none.alias("init_length"))
    ranges = dash.indexes(manifests, found=reps)
    first, size = dash.span(F.coalesce("init_range", F.lit("")))
    # An index that is not located stands somewhere after the init; the file's first bytes hold both.
    begins = ranges.select(*key, "kind", "uri", F.col("range_offset").alias("offset"), F.col("range_length").alias("length"), first.alias("init_offset"), F.coalesce(size, F.when(F.col("range_offset") > 0, F.col("range_offset"))).alias("init_length"))
    found = indexed.expand(begins, fetch)
    behind = found.select(*key, "kind", (F.col("n") + 1).alias("sequence"), "uri", F.col("uri").alias("init_uri"), (F.col("duration_ticks") / F.col("timescale")).alias("duration"), "range_offset", "range_length", (F.col("ticks") / F.col("timescale")).alias("media_start"), F.coalesce("init_offset", F.lit(0)).alias("init_offset"), F.coalesce("init_length", "range_offset").alias("init_length"))
    s = named.unionByName(behind).join(large(owner), key)
    # Numbers may begin anew in each period; the order of a rendition's segments is by period, then number.
    order = Window.partitionBy("rendition").orderBy("period_index", "sequence")
    again = F.max("period_index").over(Window.partitionBy("rendition")) > F.min("period_index").over(Window.partitionBy("rendition"))
    start = F.when(F.col("media_start").isNotNull(), _us(F.col("media_start")))
    segments = s.select(
        F.col("manifest_id").alias("stream"), "rendition", "kind", F.col("period_index").alias("period"), F.when(again, F.row_number().over(order).cast("long")).otherwise(F.col("sequence")).alias("sequence"), "uri", F.col("range_offset").alias("offset"), F.col("range_length").alias("length"), "init_uri", "init_offset", "init_length",
        text_none.alias("key_uri"), F.lit(None).cast("binary").alias("key_iv"), F.when(F.col("scheme").isNotNull(), "CENC").alias("key_method"), _us(F.col("duration")).alias("declared_us"), start.alias("declared_start_us"), none.alias("pdt_us"), (F.col("period_index") != F.coalesce(F.lag("period_index").over(order), F.col("period_index"))).alias("discontinuity"), F.col("period_index").cast("long").alias("discontinuity_sequence"), (F.col("_type") == "dynamic").alias("live"),
    )
    one = reps.groupBy("manifest_id", "rendition").agg(F.min_by(F.struct("kind", "period_index", "bandwidth", "width", "height", "codecs", "frame_rate", "sample_rate", "channels", "caption_ids", "transfer", "scheme", "drm_systems", "type"), "period_index").alias("x")).select("manifest_id", "rendition", "x.*")
    renditions = one.select(
        F.col("manifest_id").alias("stream"), "rendition", "kind", F.col("period_index").alias("period"), "bandwidth", F.nullif(F.col("width"), F.lit(0)).cast("long").alias("width"), F.nullif(F.col("height"), F.lit(0)).cast("long").alias("height"), "codecs", F.round(F.col("frame_rate") * 1000).cast("long").alias("fps_milli"), F.col("sample_rate").cast("long").alias("sample_rate"), F.col("channels").cast("long").alias("channels"),
        F.col("caption_ids").alias("captions"), F.lit(False).alias("captions_none"), text_none.alias("audio_group"), text_none.alias("group_id"), F.lit(False).alias("failed"), F.col("transfer").cast("long").alias("transfer"), text_none.alias("video_range"), "scheme", F.array_sort("drm_systems").alias("drm"), (F.col("type") == "dynamic").alias("live"), none.alias("target_us"), none.alias("part_target_us"), F.lit("dash").alias("format"),
    )
    # The segment after the newest, of one video rendition a stream: a range of it tells whether it is there before its time.
    first_rung = Window.partitionBy("manifest_id").orderBy("rendition")
    nexts = dash.next_segments(reps, now).where("kind = 'video'").join(large(owner.select(*key, "rendition")), key).withColumn("nth", F.row_number().over(first_rung)).where("nth = 1")
    nexts = saved(nexts.select("rendition", "uri", F.lit(0).cast("long").alias("offset"), F.lit(PROBE_BYTES).cast("long").alias("length")))
    ahead = fetch(nexts).select("rendition", F.col("error").isNull().alias("served"))
    # An event counts from its period's start, where the media stands at the representation's time offset.
    b = dash.ad_breaks(manifests).select("*", F.when(F.col("section").isNotNull(), stage.section_told("section")).alias("told"))
    b = b.join(large(owner.join(large(reps.where("kind = 'video'").select(*key)), key)), ["manifest_id", "period_index"])
    breaks = b.select(F.col("n").alias("break"), "rendition", F.col("told.event").alias("event"), none.alias("media_pts"), _us(F.col("offset") + F.col("pto") / F.col("_scale")).alias("media_us"), none.alias("at_sequence"), none.alias("clock_us"), F.col("told.pts").alias("section_pts"))
    return Listing(saved(renditions), saved(segments), saved(breaks), clocks=clocks, ahead=saved(ahead))


def read_bodies(requests: DataFrame, fetch: Fetch) -> DataFrame:
    """Requests (uri, offset, length, sequence and the columns of their init and key; more stay) with what was fetched, opened and parsed, written.

    Inits and keys are fetched once each and joined while the rows are small.
    """
    none = F.lit(None).cast("long")
    inits = saved(requests.where("init_uri IS NOT NULL").select(F.col("init_uri").alias("uri"), F.col("init_offset").alias("offset"), F.col("init_length").alias("length")).distinct())
    inits = fetch(inits).where("error IS NULL").select(F.col("uri").alias("_iu"), F.col("offset").alias("_io"), F.col("length").alias("_il"), F.col("body").alias("init"))
    keys = fetch(saved(requests.where("key_uri IS NOT NULL").select(F.col("key_uri").alias("uri"), none.alias("offset"), none.alias("length")).distinct())).where("error IS NULL").select(F.col("uri").alias("_ku"), F.col("body").alias("key_body"))
    same = (F.col("init_uri") == F.col("_iu")) & F.col("init_offset").eqNullSafe(F.col("_io")) & F.col("init_length").eqNullSafe(F.col("_il"))
    small = saved(requests.join(inits, same, "left").join(keys, F.col("key_uri") == F.col("_ku"), "left").drop("_iu", "_io", "_il", "_ku"))
    got = fetch(small)
    whole = F.upper(F.coalesce("key_method", F.lit(""))).isin("AES-128", "AES-256")
    opened = text.decrypted(F.col("body"), F.col("key_body"), F.coalesce("key_iv", text.sequence_iv(F.col("sequence"))))
    fetched = F.coalesce(F.col("status").isin(200, 206), F.lit(False))
    own = [c for c in requests.columns if c not in ("init_offset", "init_length", "key_uri", "key_iv")]
    flat = got.select(
        *own, F.col("status").cast("long").alias("status"), fetched.alias("fetched"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.octet_length("body").cast("long").alias("fetched_bytes"),
        (whole & fetched & opened.isNotNull()).alias("decrypted"), (whole & fetched & opened.isNull()).alias("decrypt_failed"),
        text.host(F.col("uri")).alias("host"), text.digest(F.col("body")).alias("digest"), (F.col("init_uri").isNotNull() & F.col("init").isNull()).alias("init_missing"), *[v.alias(k) for k, v in cache_columns(F.col("headers")).items()],
        F.when(fetched & (~whole | opened.isNotNull()), F.when(whole, opened).otherwise(F.col("body"))).alias("body"), "init",
    )
    return saved(stage.media(spread(flat)))


def _readable() -> Column:
    return F.col("fetched") & F.col("container").isNotNull() & F.col("supported")


def _clocked() -> Column:
    """The track that carries a body's time: the first video with a clock, else audio, else any."""
    rank = F.array_sort(F.transform(F.filter("tracks", lambda t: t["min_pts"].isNotNull()), lambda t: F.struct(F.when(t["kind"] == "video", 0).when(t["kind"] == "audio", 1).otherwise(2).alias("r"), t.alias("t"))), lambda a, b: a["r"] - b["r"])
    return F.get(rank, 0)["t"]


def probe_ranges(parsed: DataFrame, fetch: Fetch) -> DataFrame:
    """One answer a host to a request for first bytes: that of a segment that was a range itself, else one request for less than a body holds."""
    there = parsed.where("fetched AND host IS NOT NULL")
    answered = there.where("length IS NOT NULL").groupBy("host").agg(F.min_by(F.struct("status", F.col("length").alias("asked_bytes"), F.col("fetched_bytes").alias("got_bytes")), F.struct("rendition", "sequence")).alias("x")).select("host", "x.*", F.lit(False).alias("failed"))
    want = F.least(F.lit(PROBE_BYTES), F.floor(F.col("fetched_bytes") / 2)).cast("long")
    open_hosts = there.join(answered, "host", "left_anti").where(want >= 1).groupBy("host").agg(F.min_by(F.struct("uri", want.alias("length")), F.struct("rendition", "sequence")).alias("x"))
    asked = saved(open_hosts.select("host", "x.uri", F.lit(0).cast("long").alias("offset"), "x.length"))
    got = fetch(asked).select("host", F.col("status").cast("long").alias("status"), F.col("length").alias("asked_bytes"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("long").alias("got_bytes"), F.col("status").isNull().alias("failed"))
    return saved(answered.unionByName(got))


def compare_edges(parsed: DataFrame, edges: dict[str, Fetch]) -> DataFrame | None:
    """What each further edge answered to the requests that were answered: rendition, sequence, edge, missing, digest. Digests only are kept."""
    asked = parsed.where("fetched").select("rendition", "sequence", "uri", "offset", "length")
    found = None
    for edge, fetch in edges.items():
        got = saved(fetch(asked).select("rendition", "sequence", F.lit(edge).alias("edge"), F.col("error").isNotNull().alias("missing"), text.digest(F.col("body")).alias("digest")))
        found = got if found is None else found.unionByName(got)
    return found


def _parts_read(parts: DataFrame, fetch: Fetch) -> DataFrame:
    read = read_bodies(parts, fetch).withColumn("t", _clocked())
    video = F.get(F.filter("tracks", lambda t: t["kind"] == "video"), 0)
    return read.select("rendition", "sequence", "idx", "declared_us", F.col("t.min_pts").alias("min_pts"), F.col("t.timescale").alias("timescale"), (_readable() & F.col("t").isNotNull()).alias("parsed"), "independent", F.coalesce(video["opens_on_keyframe"], video.isNull()).alias("opens_keyframe"))


def relations(listing: Listing, fetch: Fetch, options: Options | None = None, *, sample: int | None = None, edges: dict[str, Fetch] | None = None) -> Relations:
    """Everything that the checks read of listed streams. ``edges``: further edges by name, each with a way to fetch from it."""
    none = F.lit(None).cast("long")
    parsed = read_bodies(first_or_last(listing.segments, sample), fetch)
    of = lambda kind: F.get(F.filter("tracks", lambda t: t["kind"] == kind), 0)
    x = parsed.withColumns({"t": _clocked(), "v": of("video"), "a": of("audio"), "own": F.coalesce(F.when(F.col("kind").isin("video", "iframe"), of("video")), F.when(F.col("kind") == "audio", of("audio")), F.get("tracks", 0))})
    span = F.coalesce(F.when(F.col("t.stated_dur") > 0, F.col("t.stated_dur")), F.when((F.col("t.samples") > 1) & (F.col("t.max_pts") >= F.col("t.min_pts")), F.col("t.max_pts") - F.col("t.min_pts") + F.col("t.frame_dur")))
    count = lambda kind: F.size(F.filter("tracks", lambda t: t["kind"] == kind)).cast("long")
    guard = F.get(F.filter("tracks", lambda t: t["protection"].isNotNull() & (t["protection"] != "sample-aes")), 0)
    # Sample encryption inside a stream without boxes: what the stream's types say, or the key over such a container.
    opaque = F.coalesce("sealed", F.lit(False)) | (F.upper(F.coalesce("key_method", F.lit(""))).startswith("SAMPLE-AES") & F.coalesce(F.col("container").isin("ts", "packed"), F.lit(False)))
    heard = F.filter("tracks", lambda t: t["captions"].isNotNull())
    segments = x.select(
        "stream", "rendition", "kind", "period", "sequence", "fetched", _readable().alias("parsed"), F.coalesce("supported", F.lit(True)).alias("supported"), "truncated", opaque.alias("opaque"), F.col("fetched_bytes").alias("bytes"), "declared_us",
        F.floor(span * 1_000_000 / F.col("t.timescale")).alias("measured_us"), "t.min_pts", "t.timescale", F.coalesce(F.aggregate("tracks", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(t["cc_errors"], F.lit(0))), F.lit(0)).alias("cc_errors"), "discontinuity", "discontinuity_sequence",
        "declared_start_us", "pdt_us", "container", "v.width", "v.height", count("video").alias("video_tracks"), count("audio").alias("audio_tracks"), "own.codec", F.when(~opaque, F.col("v.opens_on_keyframe")).alias("opens_keyframe"), F.when(~opaque, F.col("v.has_keyframe")).alias("has_keyframe"), "v.frame_dur", F.col("v.samples").alias("pictures"),
        "a.sample_rate", "a.channels", "a.object_type", "a.sbr", "a.ps", (F.col("map").isNotNull() | (F.col("container") != "webvtt")).alias("mapped"), F.col("length").isNotNull().alias("ranged"), "accepts_ranges", (F.size(heard) > 0).alias("captions_scanned"), F.array_sort(F.array_distinct(F.flatten(F.transform(heard, lambda t: t["captions"])))).alias("captions_seen"), F.col("key_method").isNotNull().alias("key_declared"), "decrypted", "decrypt_failed",
        guard.isNotNull().alias("encrypted"), guard["protection"].alias("scheme"), guard["crypt_pattern"].alias("crypt_pattern"), guard["clear_samples"].alias("clear_samples"), guard["encrypted_samples"].alias("encrypted_samples"), F.coalesce("drm", F.array().cast("array<string>")).alias("pssh"), "cache_status", "uncacheable", "host", "digest",
        F.col("v.profile").alias("profile_idc"), F.col("v.level").alias("level_idc"), F.col("v.tier").alias("tier"), F.col("v.transfer").alias("transfer"), F.col("sequence").alias("ordinal"),
    )
    missing = parsed.groupBy("rendition").agg(F.max("init_missing").alias("init_failed"))
    renditions = listing.renditions.join(large(missing), "rendition", "left").withColumn("init_failed", F.coalesce("init_failed", F.lit(False)))
    splices = parsed.select("rendition", "sequence", F.posexplode("splices").alias("k", "x")).select(F.xxhash64("rendition", "sequence", "k").alias("splice"), "rendition", F.col("x.event_id").alias("event"), F.col("x.pts").alias("pts"))
    cues = parsed.select("rendition", "sequence", F.explode("cues").alias("x")).select("rendition", "sequence", (F.col("x.begin_ms") * 1000).alias("begin_us"), (F.col("x.end_ms") * 1000).alias("end_us"))

    points = ("uri", "offset", "length", "init_uri", "init_offset", "init_length", "key_uri", "key_iv", "key_method")
    windows = windows_of(listing.renditions, listing.segments, *points)
    held = measure(windows, lambda asked: read_bodies(asked, fetch).select("rendition", _readable().alias("held")))
    return Relations(
        saved(segments), saved(renditions), splices=splices, breaks=listing.breaks, cues=cues,
        parts=saved(_parts_read(listing.parts, fetch)) if listing.parts is not None else None, probes=probe_ranges(parsed, fetch), edges=compare_edges(parsed, edges or {}), windows=held, clocks=listing.clocks, ahead=listing.ahead, options=replace(options or Options()),
    )


def from_stream(masters: DataFrame, corpus: DataFrame, options: Options | None = None, *, rungs: int | None = None, sample: int | None = None, edges: dict[str, DataFrame] | None = None, now: float | None = None) -> Relations:
    """Relations of manifests (manifest_id, url, body) of either kind whose playlists, segments and keys are in ``corpus`` (uri, status, body, headers); ``edges``: corpora of further edges."""
    of = lambda table: lambda requests: from_corpus(requests, table)
    fetch = of(corpus)
    body = F.col("body").cast("string")
    sorted_out = saved(masters.select("manifest_id", "url", body.alias("body"), hls.kind_of(F.col("url"), F.lit(None).cast("string"), body).alias("form")))
    listings = []
    for form, listing in (("hls", lambda m: hls_listing(m, fetch, rungs)), ("dash", lambda m: dash_listing(m, fetch, rungs, now))):
        own = sorted_out.where(F.col("form") == form).drop("form")
        if not own.isEmpty():
            listings.append(listing(own))
    if not listings:
        listings = [hls_listing(sorted_out.drop("form"), fetch, rungs)]
    whole = listings[0]
    for more in listings[1:]:
        whole = Listing(whole.renditions.unionByName(more.renditions), whole.segments.unionByName(more.segments), whole.breaks.unionByName(more.breaks), whole.parts, more.clocks, more.ahead)
    return relations(whole, fetch, options, sample=sample, edges={k: of(v) for k, v in (edges or {}).items()})
