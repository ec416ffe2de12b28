"""DASH manifests by ``from_xml`` with a fixed schema, nested arrays exploded; timelines expand by ``sequence``.

Input: manifest_id and body. Segment templates are inherited field by field from representation,
adaptation set and period; a stated 0 counts as unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.functions.text import iso_duration, lenient_utc, resolved
from mediaprism.storage import saved

_TEMPLATE = "STRUCT<_media: STRING, _initialization: STRING, _timescale: BIGINT, _duration: BIGINT, _startNumber: BIGINT, _presentationTimeOffset: BIGINT, SegmentTimeline: STRUCT<S: ARRAY<STRUCT<_t: BIGINT, _d: BIGINT, _r: BIGINT>>>>"
_INIT = "STRUCT<_sourceURL: STRING, _range: STRING>"
_LIST = f"STRUCT<_timescale: BIGINT, _duration: BIGINT, _startNumber: BIGINT, Initialization: {_INIT}, SegmentURL: ARRAY<STRUCT<_media: STRING, _mediaRange: STRING>>>"
_BASE = f"STRUCT<_indexRange: STRING, _timescale: BIGINT, Initialization: {_INIT}>"
_NAMED = "ARRAY<STRUCT<_schemeIdUri: STRING, _value: STRING>>"
_PROTECTION = "ARRAY<STRUCT<_schemeIdUri: STRING, _value: STRING, pssh: STRING>>"
_COMMON = f"_codecs: STRING, _mimeType: STRING, _width: INT, _height: INT, _frameRate: STRING, _audioSamplingRate: STRING, BaseURL: STRING, SegmentTemplate: {_TEMPLATE}, SegmentList: {_LIST}, SegmentBase: {_BASE}, ContentProtection: {_PROTECTION}, AudioChannelConfiguration: {_NAMED}, SupplementalProperty: {_NAMED}, EssentialProperty: {_NAMED}"
_REPRESENTATION = f"STRUCT<_id: STRING, _bandwidth: BIGINT, {_COMMON}>"
_SET = f"STRUCT<_contentType: STRING, _lang: STRING, Accessibility: {_NAMED}, {_COMMON}, Representation: ARRAY<{_REPRESENTATION}>>"
_EVENTS = "ARRAY<STRUCT<_schemeIdUri: STRING, _timescale: BIGINT, _presentationTimeOffset: BIGINT, Event: ARRAY<STRUCT<_id: STRING, _presentationTime: BIGINT, _duration: BIGINT, _VALUE: STRING, Signal: STRUCT<Binary: STRING>>>>>"
_PERIOD = f"STRUCT<_id: STRING, _start: STRING, _duration: STRING, BaseURL: STRING, EventStream: {_EVENTS}, SegmentTemplate: {_TEMPLATE}, SegmentList: {_LIST}, AdaptationSet: ARRAY<{_SET}>>"
SCHEMA = f"_type STRING, _mediaPresentationDuration STRING, _availabilityStartTime STRING, _timeShiftBufferDepth STRING, _minimumUpdatePeriod STRING, BaseURL STRING, UTCTiming {_NAMED}, Period ARRAY<{_PERIOD}>"
# Schemes of event streams that carry splice sections.
SPLICE_SCHEMES = ("urn:scte:scte35:2013:xml", "urn:scte:scte35:2014:xml+bin", "urn:scte:scte35:2013:bin")
#: Where a template leaves none of its own, timings begin there.
_CICP = {"primaries": "urn:mpeg:mpegB:cicp:ColourPrimaries", "transfer": "urn:mpeg:mpegB:cicp:TransferCharacteristics", "matrix": "urn:mpeg:mpegB:cicp:MatrixCoefficients"}


def parsed(manifests: DataFrame) -> DataFrame:
    """The documents, with the namespace prefixes of inline protection data and splice sections taken off."""
    plain = F.regexp_replace("body", "(</?)[A-Za-z0-9]+:(pssh|Signal|Binary)\\b", "$1$2")
    url = F.col("url") if "url" in manifests.columns else F.lit(None).cast("string")
    return manifests.select("manifest_id", url.alias("url"), F.from_xml(plain, SCHEMA, {"rowTag": "MPD"}).alias("mpd"))


def periods(manifests: DataFrame) -> DataFrame:
    """Periods with start and duration in seconds: stated, or following from those before; null where not known."""
    p = parsed(manifests).select("manifest_id", F.col("mpd._type").alias("type"), iso_duration(F.col("mpd._mediaPresentationDuration")).alias("whole"), "url", F.col("mpd.BaseURL").alias("base"), iso_duration(F.col("mpd._timeShiftBufferDepth")).alias("depth"), lenient_utc(F.col("mpd._availabilityStartTime")).alias("available"), F.posexplode("mpd.Period").alias("period_index", "p"))
    p = p.select("*", iso_duration(F.col("p._start")).alias("stated"), iso_duration(F.col("p._duration")).alias("length"))
    w = Window.partitionBy("manifest_id").orderBy("period_index")
    # A stated start begins an island; in it, durations add up as long as each is stated.
    p = p.withColumn("anchor", F.when(F.col("stated").isNotNull(), F.col("stated")).when(F.col("period_index") == 0, F.lit(0.0)))
    p = p.withColumn("island", F.sum(F.when(F.col("anchor").isNotNull(), 1).otherwise(0)).over(w))
    inside = Window.partitionBy("manifest_id", "island").orderBy("period_index")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.sum(F.when(F.col("length").isNull(), 1).otherwise(0)).over(before), F.lit(0)) == 0
    p = p.withColumn("start", F.when(known, F.first("anchor").over(inside) + F.coalesce(F.sum("length").over(before), F.lit(0.0))))
    following = F.lead("start").over(w)
    return p.select("manifest_id", "type", "period_index", F.col("p._id").alias("period_id"), "start", F.coalesce("length", following - F.col("start"), F.col("whole") - F.col("start")).alias("duration"), "url", "base", "depth", "available", "p")


def _unset(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def representations(manifests: DataFrame) -> DataFrame:
    """One row per period, adaptation set and representation, with the inherited template."""
    a = periods(manifests).select("*", F.posexplode("p.AdaptationSet").alias("set_index", "a"))
    r = a.select("*", F.posexplode("a.Representation").alias("rep_index", "r"))
    pick = lambda f: F.coalesce(F.col(f"r.SegmentTemplate.{f}"), F.col(f"a.SegmentTemplate.{f}"), F.col(f"p.SegmentTemplate.{f}"))
    number = lambda f: F.coalesce(_unset(F.col(f"r.SegmentTemplate.{f}")), _unset(F.col(f"a.SegmentTemplate.{f}")), _unset(F.col(f"p.SegmentTemplate.{f}")))
    mime = F.lower(F.coalesce("r._mimeType", "a._mimeType", "a._contentType", F.lit("")))
    codecs = F.coalesce("r._codecs", "a._codecs", F.lit(""))
    height = F.coalesce("r._height", "a._height")
    kind = (
        F.when(mime.startswith("video") | codecs.rlike("^(avc|hvc|hev|av01|vp)"), "video").when(mime.startswith("audio") | codecs.rlike("^(mp4a|ac-3|ec-3|opus)"), "audio")
        .when(mime.startswith("text") | codecs.rlike("^(wvtt|stpp)") | mime.contains("ttml"), "text").when(height > 0, "video").otherwise("audio")
    )
    rate = F.coalesce("r._frameRate", "a._frameRate")
    over = F.split(rate, "/")
    fps = F.try_divide(F.get(over, 0).try_cast("double"), F.coalesce(F.get(over, 1).try_cast("double"), F.lit(1.0)))
    # Each level's BaseURL is a reference against the one above, and the first against the manifest.
    at = F.col("url")
    for level in ("base", "p.BaseURL", "a.BaseURL", "r.BaseURL"):
        at = F.when(F.col(level).isNotNull(), resolved(at, F.trim(F.col(level)))).otherwise(at)
    guards = F.coalesce("r.ContentProtection", "a.ContentProtection")
    systems = lambda x: F.transform(F.filter(x, lambda g: F.lower(g["_schemeIdUri"]).startswith("urn:uuid:")), lambda g: F.substr(F.lower(g["_schemeIdUri"]), F.lit(10)))
    plain = F.get(F.filter(guards, lambda g: F.lower(g["_schemeIdUri"]) == "urn:mpeg:dash:mp4protection:2011"), 0)["_value"]
    stated = F.concat(*[F.coalesce(F.col(f"{x}.{kind}"), F.array().cast(_NAMED)) for x in ("r", "a") for kind in ("EssentialProperty", "SupplementalProperty")])
    code = lambda scheme: F.get(F.filter(stated, lambda x: x["_schemeIdUri"] == scheme), 0)["_value"].try_cast("int")
    wide = F.get(F.filter(F.coalesce("r.AudioChannelConfiguration", "a.AudioChannelConfiguration"), lambda x: x["_schemeIdUri"].startswith("urn:mpeg:dash:23003:3:audio_channel_configuration")), 0)["_value"].try_cast("int")
    heard = F.filter("a.Accessibility", lambda x: F.lower(x["_schemeIdUri"]).rlike("cea-(608|708)"))
    # ``CC1=eng;CC3=deu`` names fields, ``1=lang:eng`` and plain numbers name services.
    captions = F.flatten(F.transform(heard, lambda x: F.transform(F.split(F.coalesce(x["_value"], F.lit("")), ";"), lambda v: F.when(F.trim(v).rlike("(?i)^CC[1-4]"), F.upper(F.left(F.trim(v), F.lit(3)))).when(F.trim(v).rlike("^[0-9]+"), F.concat(F.lit("SERVICE"), F.regexp_extract(F.trim(v), "^([0-9]+)", 1))))))
    addressing = F.when(pick("_media").isNotNull(), "template").when(F.coalesce(F.col("r.SegmentList"), F.col("a.SegmentList"), F.col("p.SegmentList")).isNotNull(), "list").when(F.coalesce("r.SegmentBase", "a.SegmentBase").isNotNull(), "index").when(F.col("r.BaseURL").isNotNull(), "file").otherwise("unsupported")
    return r.select(
        "depth", "available", addressing.alias("addressing"), F.coalesce("r.SegmentList", "a.SegmentList", "p.SegmentList").alias("listed"), F.coalesce("r.SegmentBase", "a.SegmentBase").alias("indexed"),
        plain.alias("scheme"), F.coalesce(F.array_distinct(systems(guards)), F.array().cast("array<string>")).alias("drm_systems"), F.coalesce(F.array_distinct(systems(F.filter(guards, lambda g: g["pssh"].isNotNull()))), F.array().cast("array<string>")).alias("drm_in_manifest"),
        wide.alias("channels"), F.coalesce(F.array_compact(captions), F.array().cast("array<string>")).alias("caption_ids"), *[code(v).alias(k) for k, v in _CICP.items()], F.coalesce("r._audioSamplingRate", "a._audioSamplingRate").try_cast("int").alias("sample_rate"), F.col("a._lang").alias("language"),
        "manifest_id", "type", "period_index", "period_id", F.col("start").alias("period_start"), F.col("duration").alias("period_duration"), "set_index", "rep_index",
        F.col("r._id").alias("rep_id"), F.coalesce("r._bandwidth", F.lit(0)).alias("bandwidth"), F.coalesce("r._width", "a._width").alias("width"), height.alias("height"), codecs.alias("codecs"), fps.alias("frame_rate"), kind.alias("kind"),
        at.alias("base_url"),
        pick("_media").alias("media"), pick("_initialization").alias("initialization"), F.coalesce(number("_timescale"), F.lit(1)).alias("timescale"), number("_duration").alias("segment_duration"),
        F.coalesce(pick("_startNumber"), F.lit(1)).alias("start_number"), F.coalesce(number("_presentationTimeOffset"), F.lit(0)).alias("presentation_time_offset"),
        F.coalesce("r.SegmentTemplate.SegmentTimeline.S", "a.SegmentTemplate.SegmentTimeline.S", "p.SegmentTemplate.SegmentTimeline.S").alias("timeline"),
    )


def filled(template: Column, rep_id: Column, bandwidth: Column, number: Column, time: Column) -> Column:
    """``$RepresentationID$``, ``$Bandwidth$``, ``$Number$``, ``$Time$`` with optional ``%0Nd``, ``$$``; other names stay."""
    out = F.replace(template, F.lit("$$"), F.lit("\x00"))
    out = F.replace(out, F.lit("$RepresentationID$"), rep_id)
    for name, value in (("Bandwidth", bandwidth), ("Number", number), ("Time", time)):
        digits = value.cast("string")
        out = F.replace(out, F.lit(f"${name}$"), digits)
        form = F.regexp_extract(out, rf"\${name}(%0\d+d)\$", 1)
        width = F.coalesce(F.regexp_extract(form, r"%0(\d+)d", 1).try_cast("int"), F.lit(0))
        out = F.when(form != "", F.replace(out, F.concat(F.lit(f"${name}"), form, F.lit("$")), F.lpad(digits, F.greatest(width, F.length(digits)), F.lit("0")))).otherwise(out)
    return F.replace(out, F.lit("\x00"), F.lit("$"))


def segments(manifests: DataFrame, now: float | None = None, most: int = 10_000_000, live_tail: int = 12, found: DataFrame | None = None) -> DataFrame:
    """Segments of templates, lists and plain files; those behind an index come from the media (``indexed.expand``).

    A repeat below 0 fills the period; entries of no duration are skipped. Live ones without a timeline follow the clock: ``now``, seconds
    since availability start, or else this machine's time against the stated one; of them come the newest ``live_tail``. A representation of more than ``most`` segments
    is a mistake of the manifest and raises. ``found``: the representations, if they have been read; else they are, once, and written. They may carry ``clock_us``, the time that a stream goes by.
    """
    found = saved(representations(manifests)) if found is None else found
    r = found.where("media IS NOT NULL")
    key = ["manifest_id", "period_index", "set_index", "rep_index"]
    e = r.where("timeline IS NOT NULL").select("*", F.posexplode("timeline").alias("i", "s")).where("s._d > 0")
    w = Window.partitionBy(*key).orderBy("i")
    end = F.coalesce(F.lead("s._t").over(w), (F.col("period_duration") * F.col("timescale")).cast("long") + F.col("presentation_time_offset"))
    e = e.withColumn("island", F.sum(F.when(F.col("s._t").isNotNull(), 1).otherwise(0)).over(w)).withColumn("fill_end", end)
    # Only the last entry of an island can repeat to the end, so what precedes is known.
    plain = F.when(F.coalesce("s._r", F.lit(0)) >= 0, F.coalesce("s._r", F.lit(0)))
    inside = Window.partitionBy(*key, "island").orderBy("i")
    e = e.withColumn("from", F.coalesce(F.first("s._t").over(inside), F.lit(0)) + F.coalesce(F.sum(F.col("s._d") * (F.coalesce(plain, F.lit(0)) + 1)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("repeat", F.coalesce(plain, F.greatest(F.floor((F.col("fill_end") - F.col("from")) / F.col("s._d")).cast("long") - 1, F.lit(0))))
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), _bounded(F.col("repeat"), most)))).withColumn("time", F.col("from") + F.col("k") * F.col("s._d")).withColumn("d", F.col("s._d"))
    e = e.withColumn("index", F.row_number().over(Window.partitionBy(*key).orderBy("i", "k")) - 1)
    d = r.where("timeline IS NULL AND segment_duration > 0")
    length = F.col("segment_duration") / F.col("timescale")
    clock = F.unix_micros(F.current_timestamp())
    clock = F.coalesce("clock_us", clock) if "clock_us" in found.columns else clock
    passed = F.lit(now) if now is not None else (clock - F.unix_micros(F.coalesce("available", F.timestamp_seconds(F.lit(0))))) / 1e6
    d = d.withColumn("count", F.when(F.col("type") == "dynamic", F.floor((passed - F.coalesce("period_start", F.lit(0.0))) / length)).otherwise(F.ceil(F.col("period_duration") / length)).cast("long")).where("count > 0")
    first = F.when(F.col("type") == "dynamic", F.greatest(F.col("count") - live_tail, F.lit(0))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("index", F.explode(F.sequence(first, _bounded(F.col("count") - first, most) + first - 1))).withColumn("time", F.col("index") * F.col("segment_duration")).withColumn("d", F.col("segment_duration"))
    columns = [*key, "rep_id", "bandwidth", "kind", "timescale", "start_number", "media", "initialization", "base_url", "period_start", "presentation_time_offset", "index", "time", "d"]
    both = e.select(*columns).unionByName(d.select(*columns))
    number = F.col("start_number") + F.col("index")
    fill = lambda t: resolved(F.col("base_url"), filled(t, F.col("rep_id"), F.col("bandwidth"), number, F.col("time")))
    none = F.lit(None).cast("long")
    made = both.select(*key, "rep_id", "kind", number.alias("sequence"), fill(F.col("media")).alias("uri"), F.when(F.col("initialization").isNotNull(), fill(F.col("initialization"))).alias("init_uri"), (F.col("d") / F.col("timescale")).alias("duration"), (F.col("period_start") + (F.col("time") - F.col("presentation_time_offset")) / F.col("timescale")).alias("declared_start"), none.alias("range_offset"), none.alias("range_length"), (F.col("time") / F.col("timescale")).alias("media_start"))
    return made.unionByName(_listed(found, key)).unionByName(_files(found, key))


def _bounded(count: Column, most: int) -> Column:
    return F.when(count > most, F.raise_error(F.format_string("a representation of %d segments", count)).cast("bigint")).otherwise(count)


def span(text: Column) -> tuple[Column, Column]:
    """Offset and length of a range ``first-last``."""
    first, last = F.regexp_extract(text, r"^(\d+)-", 1).try_cast("long"), F.regexp_extract(text, r"-(\d+)$", 1).try_cast("long")
    return first, last - first + 1


def _listed(found: DataFrame, key: list[str]) -> DataFrame:
    r = found.where("addressing = 'list'").select("*", F.posexplode("listed.SegmentURL").alias("i", "s"))
    length = F.col("listed._duration") / F.coalesce(_unset(F.col("listed._timescale")), F.lit(1))
    offset, size = span(F.coalesce("s._mediaRange", F.lit("")))
    init = F.col("listed.Initialization._sourceURL")
    return r.select(*key, "rep_id", "kind", (F.coalesce("listed._startNumber", F.lit(1)) + F.col("i")).alias("sequence"), F.when(F.col("s._media").isNotNull(), resolved(F.col("base_url"), F.col("s._media"))).otherwise(F.col("base_url")).alias("uri"), F.when(init.isNotNull(), resolved(F.col("base_url"), init)).alias("init_uri"), length.alias("duration"), (F.col("period_start") + F.col("i") * length).alias("declared_start"), offset.alias("range_offset"), size.alias("range_length"), (F.col("i") * length).alias("media_start"))


def _files(found: DataFrame, key: list[str]) -> DataFrame:
    """A representation that is one file, as subtitles beside the media are."""
    r = found.where("addressing = 'file'")
    none = F.lit(None).cast("long")
    return r.select(*key, "rep_id", "kind", F.lit(1).cast("long").alias("sequence"), F.col("base_url").alias("uri"), F.lit(None).cast("string").alias("init_uri"), F.col("period_duration").alias("duration"), F.col("period_start").alias("declared_start"), none.alias("range_offset"), none.alias("range_length"), F.lit(None).cast("double").alias("media_start"))


def indexes(manifests: DataFrame, guess: int = 512 << 10, found: DataFrame | None = None) -> DataFrame:
    """What to read of representations behind a segment index: uri, and the range stated or the file's first bytes."""
    r = (representations(manifests) if found is None else found).where("addressing = 'index'")
    offset, size = span(F.coalesce("indexed._indexRange", F.lit("")))
    return r.select("manifest_id", "period_index", "set_index", "rep_index", "rep_id", "kind", "period_start", F.col("base_url").alias("uri"), F.coalesce(offset, F.lit(0)).alias("range_offset"), F.coalesce(size, F.lit(guess)).alias("range_length"), F.col("indexed.Initialization._range").alias("init_range"))


def events(manifests: DataFrame) -> DataFrame:
    """Events of event streams in seconds of the presentation: period, scheme, id, start, duration, and the text that carries a section."""
    e = periods(manifests).select("manifest_id", "period_index", "start", F.explode("p.EventStream").alias("x")).select("*", F.explode("x.Event").alias("e"))
    scale = F.coalesce(_unset(F.col("x._timescale")), F.lit(1))
    return e.select("manifest_id", "period_index", F.col("x._schemeIdUri").alias("scheme"), F.col("e._id").alias("id"), (F.col("start") + (F.coalesce("e._presentationTime", F.lit(0)) - F.coalesce("x._presentationTimeOffset", F.lit(0))) / scale).alias("start"), (F.col("e._duration") / scale).alias("duration"), F.trim("e._VALUE").alias("content"))


def ad_breaks(manifests: DataFrame) -> DataFrame:
    """Events of splice schemes: manifest_id, period_index, n (their place in the manifest, from 1), offset (seconds from their period's start; null if none is stated), section (bytes; null if the event holds none)."""
    e = periods(manifests).select("manifest_id", "period_index", F.posexplode("p.EventStream").alias("i", "x")).where(F.lower(F.trim("x._schemeIdUri")).isin(*SPLICE_SCHEMES))
    e = e.select("*", F.posexplode("x.Event").alias("j", "e"))
    offset = (F.col("e._presentationTime") - F.coalesce("x._presentationTimeOffset", F.lit(0))) / F.coalesce(_unset(F.col("x._timescale")), F.lit(1))
    held = F.regexp_replace(F.coalesce("e.Signal.Binary", "e._VALUE"), r"\s", "")
    place = F.row_number().over(Window.partitionBy("manifest_id").orderBy("period_index", "i", "j"))
    return e.select("manifest_id", "period_index", place.cast("long").alias("n"), offset.alias("offset"), F.when(held != "", F.try_to_binary(held, F.lit("base64"))).alias("section"))


def time_sources(manifests: DataFrame) -> DataFrame:
    """stream, n, scheme and value of the time sources that live manifests name, in order."""
    m = parsed(manifests).where("mpd._type = 'dynamic'").select(F.col("manifest_id").alias("stream"), F.posexplode("mpd.UTCTiming").alias("n", "t"))
    return m.select("stream", "n", F.col("t._schemeIdUri").alias("scheme"), F.trim("t._value").alias("value"))


def next_segments(found: DataFrame, now: float | None = None) -> DataFrame:
    """Of representations read (and their ``clock_us``, if any) of live templates by duration the address of the segment after the newest: the keys and uri."""
    r = found.where("type = 'dynamic' AND addressing = 'template' AND timeline IS NULL AND segment_duration > 0")
    clock = F.unix_micros(F.current_timestamp())
    clock = F.coalesce("clock_us", clock) if "clock_us" in found.columns else clock
    passed = F.lit(now) if now is not None else (clock - F.unix_micros(F.coalesce("available", F.timestamp_seconds(F.lit(0))))) / 1e6
    count = F.greatest(F.floor((passed - F.coalesce("period_start", F.lit(0.0))) * F.col("timescale") / F.col("segment_duration")), F.lit(0)).cast("long")
    uri = resolved(F.col("base_url"), filled(F.col("media"), F.col("rep_id"), F.col("bandwidth"), F.col("start_number") + count, count * F.col("segment_duration")))
    return r.select("manifest_id", "period_index", "set_index", "rep_index", "kind", uri.alias("uri"))


def window_edges(manifests: DataFrame, now: float, probes: int = 16) -> DataFrame:
    """Of live templates by duration: the next segment's number, the oldest one that should still be there, and numbers evenly between to probe.

    ``now``: seconds since availability start.
    """
    r = representations(manifests).where("type = 'dynamic' AND addressing = 'template' AND timeline IS NULL AND segment_duration > 0")
    length, start = F.col("segment_duration") / F.col("timescale"), F.coalesce("period_start", F.lit(0.0))
    count = F.greatest(F.floor((F.lit(now) - start) / length), F.lit(0)).cast("long")
    oldest = F.least(F.greatest(F.ceil((F.lit(now) - start - F.coalesce("depth", F.lit(now))) / length), F.lit(0)).cast("long"), F.greatest(count - 1, F.lit(0)))
    step = (count - 1 - oldest) / F.lit(float(probes - 1))
    probed = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda k: F.col("start_number") + F.floor(oldest + k * step + 0.5).cast("long")))
    return r.select("manifest_id", "period_index", "set_index", "rep_index", "rep_id", (F.col("start_number") + count).alias("next"), F.when(count > 0, F.col("start_number") + oldest).alias("oldest"), F.when(count > 0, probed).otherwise(F.array().cast("array<bigint>")).alias("probes"), (count <= 0).alias("unsupported"))
