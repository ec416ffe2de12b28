"""Checks of content: what was fetched and parsed, what the tracks hold, and how they are protected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.findings import finding, together
from mediaprism.functions.codecs import aac_object_type, declared_family, declared_video, range_of_transfer
from mediaprism.operators.common import Relations, first_by, label, of_stream, place, upper_median
from mediaprism.options import AVC_TIERS
from mediaprism.storage import large


def _count(condition):
    return F.sum(F.coalesce(condition.cast("int"), F.lit(0)))


def manifest(rel: Relations) -> DataFrame:
    """One statement per playlist: unreachable, unusable (it states no bandwidth where it has to), or its shape."""
    n = rel.all_segments.groupBy("rendition").agg(F.count("*").alias("n"))
    r = rel.all_renditions.join(large(n), "rendition", "left")
    rule = F.when(F.col("failed"), "unreachable").when(F.col("bandwidth") <= 0, "unusable").otherwise("shape")
    return finding(r, "manifest", rule, label(), F.when(F.col("failed"), "ERROR").when(F.col("bandwidth") <= 0, "BAD").otherwise("OK"), F.coalesce("n", F.lit(0)))


def fetch(rel: Relations) -> DataFrame:
    s = rel.segments
    empty = rel.renditions.join(large(s), "rendition", "left_anti")
    good = s.groupBy("rendition").agg(_count(F.col("fetched")).alias("n")).where("n > 0")
    return together(
        finding(rel.all_renditions.where("failed"), "fetch", "rendition", label(), "ERROR"),
        finding(empty, "fetch", "empty", label(), "BAD"),
        finding(s.where("NOT fetched"), "fetch", "segment", place(), "ERROR"),
        finding(s.where("fetched AND truncated"), "fetch", "truncated", place(), "WARN", F.col("bytes")),
        finding(good, "fetch", "fetched", label(), "OK", F.col("n")),
    )


def init(rel: Relations) -> DataFrame:
    return finding(rel.renditions.where("init_failed"), "init", "unfetched", label(), "ERROR")


def container(rel: Relations) -> DataFrame:
    s = rel.segments
    g = rel.parsed.groupBy("rendition").agg(F.countDistinct("container").alias("kinds"), _count(F.col("opaque")).alias("opaque"))
    other = s.where("fetched AND NOT parsed AND NOT supported").groupBy("rendition").agg(F.count("*").alias("n"))
    return together(
        finding(s.where("fetched AND NOT parsed AND supported"), "container", "unparseable", place(), "BAD", F.col("bytes")),
        # Known for what it is, but of a kind that is not read.
        finding(other, "container", "unsupported", label(), "OK", F.col("n")),
        finding(g.where("opaque > 0"), "container", "opaque", label(), "OK", F.col("opaque")),
        finding(g, "container", F.when(F.col("kinds") > 1, "mixed").otherwise("uniform"), label(), F.when(F.col("kinds") > 1, "WARN").otherwise("OK"), F.col("kinds")),
    )


def _rates(rel: Relations) -> DataFrame:
    m = rel.of(rel.parsed.where("measured_us > 0"), "bandwidth", "live").withColumn("bps", (F.col("bytes") * 8_000_000).cast("double") / F.col("measured_us"))
    return m.groupBy("rendition", "kind", "r_bandwidth").agg(first_by([-F.col("bps"), F.col("sequence")], "sequence", "bps").alias("peak"), ((F.sum("bytes") * 8_000_000).cast("double") / F.sum("measured_us")).alias("avg"))


def bitrate(rel: Relations) -> DataFrame:
    g = _rates(rel).where("r_bandwidth > 0")
    over = F.col("peak.bps") * 100 > F.col("r_bandwidth") * (100 + rel.options.bitrate_pct)
    under = F.col("avg") * 2 < F.col("r_bandwidth")
    g = g.withColumn("sequence", F.col("peak.sequence"))
    rule = F.when(over, "peak").when(under, "overdeclared").otherwise("within")
    return finding(g, "bitrate", rule, F.when(over, place()).otherwise(label()), F.when(over | under, "WARN").otherwise("OK"), F.when(over, F.col("peak.bps")).otherwise(F.col("avg")))


def resolution(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("kind = 'video' AND width IS NOT NULL"), "width", "height", with_init=True).where("r_width IS NOT NULL")
    off = (F.col("width") != F.col("r_width")) | (F.col("height") != F.col("r_height"))
    g = s.groupBy("rendition").agg(F.min(F.when(off, F.col("sequence"))).alias("sequence"), F.count("*").alias("n"))
    bad = F.col("sequence").isNotNull()
    return finding(g, "resolution", F.when(bad, "differs").otherwise("agrees"), F.when(bad, place()).otherwise(label()), F.when(bad, "BAD").otherwise("OK"), F.col("n"))


def tracks(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("kind IN ('video', 'audio')"), "codecs", with_init=True)
    s = s.withColumn("family", declared_family(F.col("r_codecs"), F.col("kind")))
    g = s.groupBy("rendition", "kind", "r_codecs", "family").agg(F.count("*").alias("n"), _count(F.col("video_tracks") == 0).alias("blind"), F.countDistinct("video_tracks", "audio_tracks").alias("layouts"), F.min_by("codec", "sequence").alias("codec"))
    v = g.where("kind = 'video' AND blind > 0")
    gone = F.col("blind") == F.col("n")
    status = F.when(gone & F.col("family").isNotNull(), "BAD").when(gone, "OK").otherwise("WARN")
    return together(
        finding(v, "tracks", F.when(gone, "no-video").otherwise("video-missing"), label(), status, F.col("blind")),
        finding(g.where("layouts > 1"), "tracks", "layout", label(), "WARN", F.col("layouts")),
        finding(g.where("codec <> family"), "tracks", "codec", label(), "WARN"),
        finding(g.where("layouts = 1 AND (family IS NULL OR codec = family) AND (kind <> 'video' OR blind = 0)"), "tracks", "consistent", label(), "OK", F.col("n")),
    )


def keyframe(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("kind NOT IN ('audio', 'text')"), with_init=True)
    readable = F.col("opens_keyframe").isNotNull() & ~F.col("opaque")
    g = s.groupBy("rendition").agg(_count(readable).alias("n"), _count(readable & ~F.col("has_keyframe")).alias("none"), _count(readable & ~F.col("opens_keyframe")).alias("late"))
    rule = F.when(F.col("n") == 0, "unverified").when(F.col("none") > 0, "none").when(F.col("late") > 0, "late").otherwise("opens")
    value = F.when(F.col("n") == 0, 0).when(F.col("none") > 0, F.col("none")).when(F.col("late") > 0, F.col("late")).otherwise(F.col("n"))
    return finding(g, "keyframe", rule, label(), F.when(F.col("none") > 0, "BAD").otherwise("OK"), value)


def framerate(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("kind <> 'audio' AND frame_dur > 0"), "fps_milli", with_init=True)
    g = s.groupBy("stream", "rendition", "kind", "r_fps_milli").agg(upper_median(F.floor((F.col("timescale") * 1000).cast("double") / F.col("frame_dur")).cast("long")).alias("fps"))
    off = F.abs(F.col("fps") - F.col("r_fps_milli")) * 100 > F.col("r_fps_milli") * rel.options.frame_rate_pct
    rule = F.when(F.col("r_fps_milli").isNull(), "undeclared").when(off, "differs").otherwise("agrees")
    own = finding(g, "framerate", rule, label(), F.when(off, "WARN").otherwise("OK"), F.col("fps") / 1000)
    v = g.where("kind = 'video'")
    ladder = Window.partitionBy("stream")
    v = v.select("stream", "fps", F.max("fps").over(ladder).alias("top"), F.count("*").over(ladder).alias("rungs"))
    ratio = F.col("top").cast("double") / F.col("fps")
    whole = F.greatest(F.floor(ratio + 0.5).cast("double"), F.lit(1.0))
    odd = v.where("rungs > 1").where(F.abs(ratio - whole) * 100 > whole * rel.options.frame_rate_pct).groupBy("stream").agg(F.count("*").alias("n"))
    return together(own, finding(odd, "framerate", "ladder", of_stream("ladder"), "WARN", F.col("n")))


def audio(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("kind = 'audio' AND (sample_rate IS NOT NULL OR channels IS NOT NULL)"), "sample_rate", "channels", "codecs", with_init=True)
    g = s.groupBy("rendition", "r_sample_rate", "r_channels", "r_codecs").agg(F.count_distinct(F.struct("sample_rate", "channels", "codec")).alias("shapes"), first_by([F.col("sequence")], "sample_rate", "channels", "codec", "sbr", "ps").alias("f"))
    # Measured band replication doubles the rate that plays, parametric stereo makes two channels of one.
    doubled = F.coalesce(F.col("f.sbr") & (F.col("f.sample_rate") * 2 == F.col("r_sample_rate")), F.lit(False))
    widened = F.coalesce(F.col("f.ps") & (F.col("f.channels") == 1) & (F.col("r_channels") == 2), F.lit(False))
    codec = F.coalesce(declared_family(F.col("r_codecs"), F.lit("audio")) != F.col("f.codec"), F.lit(False))
    rate = F.coalesce((F.col("r_sample_rate") != F.col("f.sample_rate")) & ~doubled, F.lit(False))
    channels = F.coalesce((F.col("r_channels") != F.col("f.channels")) & ~widened, F.lit(False))
    rule = F.when(F.col("shapes") > 1, "varies").when(codec | rate | channels, F.concat_ws("+", F.when(codec, "codec"), F.when(rate, "rate"), F.when(channels, "channels"))).otherwise("agrees")
    return finding(g, "audio", rule, label(), F.when((F.col("shapes") > 1) | codec | rate | channels, "BAD").otherwise("OK"), F.col("shapes"))


def captions(rel: Relations) -> DataFrame:
    """All declared services against all that are seen. An analogue service stands for its field, a caption track for all services of its family; ids that are not known pass."""
    s = rel.of(rel.parsed.where("kind = 'video'"), "captions", "captions_none", with_init=True)
    scanned = F.col("captions_scanned") & ~F.col("opaque")
    field = lambda c: F.when(c.isin("CC1", "CC3"), "field1").when(c.isin("CC2", "CC4"), "field2").otherwise(c)
    g = s.groupBy("rendition", "r_captions", "r_captions_none").agg(_count(scanned).alias("n"), F.array_distinct(F.flatten(F.collect_list(F.when(scanned, F.col("captions_seen"))))).alias("seen"))
    seen = F.transform("seen", field)
    known = lambda c: c.rlike("^(CC[1-4]|SERVICE[0-9]+)$")
    there = lambda c: F.array_contains(seen, field(c)) | (F.array_contains("seen", "c608") & c.startswith("CC")) | (F.array_contains("seen", "c708") & c.startswith("SERVICE"))
    declared = F.size("r_captions") > 0
    g = g.withColumn("gone", F.size(F.filter("r_captions", lambda c: known(c) & ~there(c)))).withColumn("rule", F.when(declared & (F.col("n") == 0), "unscanned").when(declared & (F.col("gone") > 0), "missing").when(F.col("r_captions_none") & (F.size("seen") > 0), "unexpected").otherwise("agrees"))
    status = F.when(F.col("rule") == "unscanned", "ERROR").when(F.col("rule") == "missing", "BAD").when(F.col("rule") == "unexpected", "WARN").otherwise("OK")
    return finding(g, "captions", F.col("rule"), label(), status, F.when(F.col("rule") == "missing", F.col("gone")).otherwise(F.size("seen")))


def encryption(rel: Relations) -> DataFrame:
    g = rel.segments.where("fetched").groupBy("rendition").agg(F.count("*").alias("n"), _count(F.col("key_declared")).alias("said"), _count(F.col("decrypted")).alias("open"), _count(F.col("decrypt_failed")).alias("failed"), _count(F.col("encrypted")).alias("seen"))
    cases = [("failed > 0", "undecrypted", "ERROR", "failed"), ("open > 0", "decrypted", "OK", "open"), ("said = 0 AND seen > 0", "undeclared", "BAD", "seen"), ("said > 0 AND said < n", "partial", "WARN", "said"), ("said > 0", "declared", "OK", "said")]
    rule = status = value = None
    for when, r, st, v in cases:
        c = F.expr(when)
        rule, status, value = (F.when(c, x) if old is None else old.when(c, x) for old, x in ((rule, F.lit(r)), (status, F.lit(st)), (value, F.col(v))))
    return finding(g.withColumn("rule", rule).withColumn("status", status).withColumn("value", value).where("rule IS NOT NULL"), "encryption", F.col("rule"), label(), F.col("status"), F.col("value"))


def ladder(rel: Relations) -> DataFrame:
    r = rel.renditions
    v = r.where("kind = 'video'")
    same = v.where("width > 0 AND height > 0 AND bandwidth > 0").groupBy("stream", "period", "width", "height", "bandwidth").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("stream", "period").orderBy("bandwidth", "rendition")
    lower = v.where("height IS NOT NULL").select("*", F.lag("height").over(w).alias("below")).where("height < below")
    defined = r.where("kind = 'audio' AND group_id IS NOT NULL").select("stream", F.col("group_id").alias("audio_group")).distinct()
    dangling = v.where("audio_group IS NOT NULL").join(large(defined), ["stream", "audio_group"], "left_anti")
    none = r.groupBy("stream").agg(_count(F.col("kind") == "video").alias("n")).where("n = 0")
    at = of_stream("p", F.col("period").cast("string"), F.lit(":"), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit("@"), F.col("bandwidth").cast("string"))
    return together(
        finding(none, "ladder", "no-video", of_stream("ladder"), "BAD"),
        finding(same, "ladder", "duplicate", at, "WARN", F.col("n")),
        finding(lower, "ladder", "inverted", label(), "WARN", F.col("below") - F.col("height")),
        finding(dangling, "ladder", "audio-group", label(), "BAD"),
        finding(v.where("codecs = ''"), "ladder", "no-codecs", label(), "WARN"),
    )


def pop(rel: Relations) -> DataFrame:
    """The reference copy of each segment against that of each edge, by digest: one statement an edge; without edges there is nothing to say."""
    reference = rel.segments.where("fetched").select("stream", "rendition", "sequence", F.col("digest").alias("reference"))
    g = rel.edges.join(large(reference), ["rendition", "sequence"]).groupBy("stream", "edge").agg(F.count("*").alias("n"), _count(F.col("missing")).alias("gone"), _count(~F.col("missing") & (F.col("digest") != F.col("reference"))).alias("other"))
    whole = g.groupBy("stream").agg(F.sum(F.col("gone") + F.col("other")).alias("off"), F.max("n").alias("n"))
    at = of_stream(F.col("edge"))
    return together(
        finding(g.where("gone = n"), "pop", "unreachable", at, "ERROR"),
        finding(g.where("gone > 0 AND gone < n"), "pop", "missing", at, "BAD", F.col("gone")),
        finding(g.where("other > 0"), "pop", "differs", at, "BAD", F.col("other")),
        finding(whole.where("off = 0"), "pop", "agrees", of_stream("edges"), "OK", F.col("n")),
    )


def cache(rel: Relations) -> DataFrame:
    s = rel.of(rel.segments.where("fetched"), "live")
    g = s.groupBy("rendition", "r_live").agg(_count(F.col("uncacheable")).alias("not"), F.count("cache_status").alias("known"), _count(F.col("cache_status") == "MISS").alias("miss"))
    rule = F.when(F.col("known") == 0, "silent").when(F.col("miss") == F.col("known"), "all-miss").otherwise("hits")
    status = F.when((F.col("known") > 0) & (F.col("miss") == F.col("known")), F.when(F.col("r_live"), "BAD").otherwise("WARN")).otherwise("OK")
    hits = F.when(F.col("known") > 0, (F.col("known") - F.col("miss")) * 100 / F.col("known")).otherwise(0)
    return together(finding(g.where("not > 0"), "cache", "uncacheable", label(), "BAD", F.col("not")), finding(g, "cache", rule, label(), status, hits))


def byterange(rel: Relations) -> DataFrame:
    """What each host answered to a request for its first bytes, against what its segments need and it advertises."""
    s = rel.segments.where("fetched")
    g = s.groupBy("stream", "host").agg(F.max("ranged").alias("needed"), F.max("accepts_ranges").alias("advertised")).join(rel.probes, "host")
    exact = (F.col("status") == 206) & (F.col("got_bytes") == F.col("asked_bytes"))
    rule = F.when(F.col("failed"), "probe-failed").when(exact, "partial").when(F.col("needed"), "needed").when(F.col("advertised"), "advertised").otherwise("unused")
    status = F.when(F.col("failed"), "ERROR").when(exact, "OK").when(F.col("needed"), "BAD").when(F.col("advertised"), "WARN").otherwise("OK")
    return finding(g, "byterange", rule, of_stream(F.col("host")), status, F.col("got_bytes"))


def codecstring(rel: Relations) -> DataFrame:
    """Profile, level and tier that the string declares against those of the first media that states any, each told of its own; then the audio's object type.

    Declared below what is coded, players fail at the decoder; declared above, players that could are kept away.
    """
    v = rel.of(rel.parsed.where("kind = 'video' AND profile_idc IS NOT NULL"), "codecs").where("r_codecs <> ''")
    g = v.groupBy("rendition", "r_codecs").agg(first_by([F.col("sequence")], "profile_idc", "level_idc", "tier").alias("f")).withColumn("d", declared_video(F.col("r_codecs")))

    def told(rule: Column | str, status: Column | str, value: str) -> Column:
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in (("rule", rule), ("status", status))], F.col(value).cast("double").alias("value"))

    def apart(name: str, said: str, got: str) -> Column:
        below = F.col(said) < F.col(got)
        return F.when(F.col(said) != F.col(got), told(F.concat(F.lit(name), F.when(below, "-understated").otherwise("-overstated")), F.when(below, "BAD").otherwise("WARN"), got))

    off = F.array_compact(F.array(apart("profile", "d.profile", "f.profile_idc"), apart("level", "d.level", "f.level_idc"), F.when(F.col("d.tier") != F.col("f.tier"), told("tier-differs", "WARN", "f.tier"))))
    said = F.when(F.col("d").isNull(), F.array(told("undecomposable", "OK", "f.level_idc"))).when(F.size(off) > 0, off).otherwise(F.array(told("agrees", "OK", "f.level_idc")))
    g = g.select("rendition", F.explode(said).alias("x"))
    video = finding(g, "codecstring", F.col("x.rule"), label(), F.col("x.status"), F.col("x.value"))
    a = rel.of(rel.parsed.where("kind = 'audio'"), "codecs").groupBy("rendition", "r_codecs").agg(F.min_by("codec", "sequence").alias("codec"), first_by([F.col("object_type").isNull(), F.col("sequence")], "object_type", "sbr").alias("m"))
    said, got = aac_object_type(F.col("r_codecs")), F.col("m.object_type")
    family = F.coalesce(declared_family(F.col("r_codecs"), F.lit("audio")) != F.col("codec"), F.lit(False))
    efficient, replicated = said.isin(5, 29), F.coalesce(F.col("m.sbr"), F.lit(False))
    rule = (
        F.when(family, "family").when(said.isNull() | got.isNull(), "no-type").when(said == got, F.when(replicated & ~efficient, "sbr-undeclared").otherwise("type-agrees"))
        .when(efficient & (got == 2), "he-over-lc").when((replicated | got.isin(5, 29)) & ~efficient, "sbr-undeclared").otherwise("type-differs")
    )
    a = a.withColumn("rule", rule)
    return together(video, finding(a, "codecstring", F.col("rule"), label(), F.when(F.col("rule").isin("family", "sbr-undeclared"), "BAD").when(F.col("rule") == "type-differs", "WARN").otherwise("OK"), got))


def videorange(rel: Relations) -> DataFrame:
    g = rel.of(rel.parsed.where("kind = 'video'"), "transfer", "video_range").groupBy("rendition", "r_transfer", "r_video_range").agg(F.min_by("transfer", F.when(F.col("transfer").isNotNull(), F.col("sequence"))).alias("t"))
    off_t, off_r = F.col("r_transfer") != F.col("t"), F.col("r_video_range") != range_of_transfer(F.col("t"))
    rule = F.when(F.col("t").isNull(), "unstated").when(off_t, "transfer").when(off_r, "range").otherwise("agrees")
    return finding(g, "videorange", rule, label(), F.when(off_t | off_r, "BAD").otherwise("OK"), F.col("t"))


def clear(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed, "scheme")
    w = Window.partitionBy("rendition").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("begun", F.coalesce(F.max(F.when(F.col("encrypted_samples") > 0, 1)).over(w), F.lit(0)))
    g = s.groupBy("rendition").agg(
        F.max(F.col("key_declared") | F.col("encrypted") | F.col("r_scheme").isNotNull()).alias("claims"),
        F.count("encrypted_samples").alias("known"),
        F.sum("encrypted_samples").alias("enc"),
        F.sum(F.when(F.col("begun") == 0, F.floor(F.col("clear_samples") * F.col("frame_dur") * 1_000_000 / F.col("timescale"))).otherwise(0)).alias("lead_us"),
        F.sum(F.when((F.col("begun") == 0) & (F.col("clear_samples") > 0) & F.col("frame_dur").isNull(), 1).otherwise(0)).alias("untold"),
    ).where("claims")
    asked = rel.options.clear_lead_us
    # Clear samples of unknown length leave the lead unknown, which is no defect.
    off = F.lit(False) if asked is None else (F.col("untold") == 0) & (F.abs(F.col("lead_us") - asked) > rel.options.clear_lead_slack_us)
    rule = F.when(F.col("known") == 0, "unknown").when(F.col("enc") == 0, "nothing-encrypted").when(off, "lead").when(F.col("untold") > 0, "lead-unknown").otherwise("encrypted")
    status = F.when(F.col("known") == 0, "OK").when((F.col("enc") == 0) | off, "BAD").otherwise("OK")
    return finding(g, "clear", rule, label(), status, F.when((F.col("known") > 0) & (F.col("untold") == 0), F.round(F.col("lead_us") / 1e6, 3)))


def scheme(rel: Relations) -> DataFrame:
    s = rel.of(rel.parsed.where("scheme IS NOT NULL"), "scheme")
    g = s.groupBy("stream", "rendition", "kind", "r_scheme").agg(first_by([F.col("sequence")], "scheme", "crypt_pattern").alias("f"))
    patterned = F.col("f.scheme").isin("cbcs", "cens")
    rule = F.when(F.col("f.crypt_pattern") & ~patterned, "pattern-without").when(patterned & (F.col("kind") == "video") & ~F.col("f.crypt_pattern"), "pattern-missing").when(F.col("r_scheme") != F.col("f.scheme"), "differs").otherwise("agrees")
    own = finding(g.withColumn("rule", rule), "scheme", F.col("rule"), label(), F.when(F.col("rule") == "agrees", "OK").otherwise("BAD"))
    several = g.groupBy("stream").agg(F.countDistinct("f.scheme").alias("n")).where("n > 1")
    return together(own, finding(several, "scheme", "ladder", of_stream("ladder"), "BAD", F.col("n")))


def drm(rel: Relations) -> DataFrame:
    """Protection systems: those that the manifest declares against those that the media names, as sets."""
    s = rel.of(rel.parsed, "drm")
    g = s.groupBy("rendition", F.col("r_drm").alias("said")).agg(F.array_distinct(F.flatten(F.collect_list("pssh"))).alias("there")).where("size(said) > 0 OR size(there) > 0")
    missing = g.select("rendition", F.explode(F.array_except("said", "there")).alias("system"), "there")
    extra = g.select("rendition", F.explode(F.array_except("there", "said")).alias("system"))
    at = F.concat_ws("/", label(), F.col("system"))
    return together(
        finding(missing.where("size(there) > 0"), "drm", "missing", at, "BAD"),
        finding(g.where("size(there) = 0"), "drm", "no-pssh", label(), "OK"),
        finding(extra, "drm", "undeclared", at, "WARN"),
        finding(g.where("size(there) > 0 AND size(array_except(said, there)) = 0 AND size(array_except(there, said)) = 0"), "drm", "agrees", label(), "OK"),
    )


def _openings(s: DataFrame, *keys: str) -> DataFrame:
    """Of each rendition how many openings are known, which are no keyframe for certain, and which are not settled.

    Where the container states it there is nothing to argue with; a bitstream that holds a keyframe elsewhere is no evidence, in decode order, either way.
    """
    known = F.col("opens_keyframe").isNotNull() & ~F.col("opaque")
    late = known & ~F.col("opens_keyframe")
    bad = late & ((F.col("container") == "mp4") | ~F.coalesce("has_keyframe", F.lit(True)))
    return s.groupBy("rendition", *keys).agg(F.count("*").alias("n"), _count(known).alias("verified"), _count(bad).alias("bad"), _count(late & ~bad).alias("unsettled"), F.min(F.when(bad, F.col("sequence"))).alias("sequence"), _count(F.col("pictures") > 1).alias("several"))


def iframe(rel: Relations) -> DataFrame:
    """I-frame playlists: readable, one keyframe an entry, and on the timeline of the video of their size."""
    s = rel.segments.where("kind = 'iframe'")
    gone = s.groupBy("rendition").agg(_count(~F.col("parsed")).alias("gone"))
    empty = rel.renditions.where("kind = 'iframe'").join(large(s), "rendition", "left_anti")
    g = _openings(rel.parsed.where("kind = 'iframe'"))
    start = F.floor(F.col("min_pts") * 1_000_000 / F.col("timescale"))
    begins = rel.parsed.where("min_pts IS NOT NULL AND kind IN ('video', 'iframe')").groupBy("stream", "rendition", "kind").agg(F.min_by(start, "sequence").alias("start")).join(large(rel.renditions.select("rendition", "width", "height")), "rendition")
    video, own = begins.where("kind = 'video'").drop("kind"), begins.where("kind = 'iframe'").drop("kind")
    # The last rung of the same size speaks for the video, else the first of any.
    pairs = own.join(video.select("stream", F.col("rendition").alias("rung"), F.col("start").alias("video"), F.col("width").alias("_w"), F.col("height").alias("_h")), "stream")
    same = F.coalesce((F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")), F.lit(False))
    near = pairs.groupBy("stream", "rendition", "start").agg(F.min_by("video", F.struct((~same).alias("other"), F.when(same, -F.col("rung")).otherwise(F.col("rung")).alias("nth"))).alias("video"))
    lasts = rel.parsed.where("measured_us > 0").groupBy("stream", "rendition").agg(upper_median(F.col("measured_us")).alias("lasts")).groupBy("stream").agg(F.min_by("lasts", "rendition").alias("slack"))
    near = near.join(lasts, "stream", "left").withColumn("drift", F.col("start") - F.col("video")).withColumn("on", F.abs("drift") <= F.coalesce("slack", F.lit(2_000_000)))
    return together(
        finding(empty, "iframe", "empty", label(), "ERROR"),
        finding(gone.where("gone > 0"), "iframe", "unreadable", label(), "BAD", F.col("gone")),
        finding(g.where("bad > 0"), "iframe", "no-keyframe", place(), "BAD", F.col("bad")),
        finding(g.where("several > 0"), "iframe", "several-pictures", label(), "WARN", F.col("several")),
        finding(g.where("bad = 0 AND verified = 0"), "iframe", "unverified", label(), "OK", F.col("n")),
        finding(g.where("bad = 0 AND verified > 0"), "iframe", F.when(F.col("unsettled") > 0, "unsettled").otherwise("opens"), label(), "OK", F.col("verified")),
        finding(near, "iframe", F.when(F.col("on"), "same-timeline").otherwise("other-timeline"), label(), F.when(F.col("on"), "OK").otherwise("BAD"), F.col("drift") / 1000),
    )


def _apple_peak(rel: Relations) -> list[DataFrame]:
    g = _rates(rel).where("kind = 'video'").withColumn("ratio", F.col("peak.bps") / F.col("avg"))
    return [finding(g, "profile", "apple:peak-vs-average", label(), F.when(F.col("ratio") > 2, "WARN").otherwise("OK"), F.round("ratio", 6))]


def _apple_duration(rel: Relations) -> list[DataFrame]:
    """Within a rendition, where a shorter last one of an ended presentation does not count; and the shortest rung against the longest."""
    d = rel.of(rel.parsed.where("kind <> 'text' AND measured_us > 0"), "live")
    whole = Window.partitionBy("rendition")
    d = d.select("stream", "rendition", "kind", "sequence", "measured_us", "r_live", F.count("*").over(whole).alias("n"), F.max("sequence").over(whole).alias("last"), F.min_by("measured_us", "sequence").over(whole).alias("first_us"))
    kept = d.where(~(~F.col("r_live") & (F.col("n") > 1) & (F.col("sequence") == F.col("last")) & (F.col("measured_us") < F.col("first_us"))))
    usual = kept.groupBy("rendition").agg(upper_median(F.col("measured_us")).alias("usual"), F.count("*").alias("n"), F.min("measured_us").alias("low"), F.max("measured_us").alias("high")).where("n > 1")
    pct = F.greatest(F.col("usual") - F.col("low"), F.col("high") - F.col("usual")).cast("double") * 100 / F.col("usual")
    off = pct > rel.options.profile_duration_pct
    rungs = d.where("kind = 'video'").groupBy("stream", "rendition").agg(upper_median(F.col("measured_us")).alias("usual"))
    ends = rungs.groupBy("stream").agg(F.min(F.struct("usual", "rendition")).alias("low"), F.max(F.struct("usual", (-F.col("rendition")).alias("nth"))).alias("high"), F.count("*").alias("n")).where("n > 1")
    apart = ends.where((F.col("high.usual") - F.col("low.usual")) * 100 > F.col("low.usual") * rel.options.profile_duration_pct)
    at = of_stream("ladder:r", F.col("low.rendition").cast("string"), F.lit(":r"), (-F.col("high.nth")).cast("string"))
    return [
        finding(usual, "profile", "apple:segment-duration", label(), F.when(off, "WARN").otherwise("OK"), F.when(off, F.round(pct, 6)).otherwise(F.col("usual") / 1e6)),
        finding(apart, "profile", "apple:segment-duration", at, "WARN", (F.col("high.usual") - F.col("low.usual")) / 1000),
    ]


def _apple_idr(rel: Relations) -> list[DataFrame]:
    g = _openings(rel.of(rel.parsed.where("kind = 'video'"), with_init=True)).where("verified > 0")
    bad = F.col("bad") > 0
    return [finding(g, "profile", "apple:idr-per-segment", F.when(bad, place()).otherwise(label()), F.when(bad, "WARN").otherwise("OK"), F.when(bad, F.col("bad")).when(F.col("unsettled") > 0, F.col("unsettled")).otherwise(F.col("verified")))]


def _apple_tier(rel: Relations) -> list[DataFrame]:
    """The measured average against the tier of the nearest size, by the logarithm of pixels; the table covers one codec."""
    rates = _rates(rel).where("kind = 'video'")
    coded = rel.parsed.where("kind = 'video'").groupBy("rendition").agg(F.min_by(F.struct("width", "height"), F.when(F.col("width") > 0, F.col("sequence"))).alias("f"), F.min_by("codec", F.when(F.col("codec").isNotNull(), F.col("sequence"))).alias("codec"))
    g = rates.join(large(coded), "rendition").join(large(rel.renditions.select("rendition", F.col("width").alias("_w"), F.col("height").alias("_h"))), "rendition")
    g = g.withColumn("pixels", F.coalesce(F.col("f.width") * F.col("f.height"), F.col("_w") * F.col("_h"))).where("pixels > 0")
    near = F.array_sort(F.array(*[F.struct(F.abs(F.ln(F.col("pixels").cast("double") / (w * h))).alias("far"), F.lit(i).alias("i"), F.lit(kbps).alias("kbps")) for i, (w, h, kbps) in enumerate(AVC_TIERS)]))
    other = F.coalesce(F.col("codec") != "h264", F.lit(False))
    g = g.withColumn("share", F.when(~other, F.col("avg") / (F.get(near, 0)["kbps"] * 1000)))
    return [finding(g, "profile", "apple:bitrate-tier", label(), F.when((F.col("share") < 0.5) | (F.col("share") > 2), "WARN").otherwise("OK"), F.round("share", 6))]


def _apple_rate(rel: Relations) -> list[DataFrame]:
    """A constant rate in each rung, and all rungs at the top rung's or a whole fraction of it."""
    s = rel.of(rel.parsed.where("kind = 'video' AND frame_dur > 0"), with_init=True)
    s = s.withColumn("fps", F.floor((F.col("timescale") * 1000).cast("double") / F.col("frame_dur")).cast("long"))
    g = s.groupBy("stream", "rendition").agg(upper_median(F.col("fps")).alias("usual"), F.min("fps").alias("low"), F.max("fps").alias("high"))
    worst = F.when(F.col("usual") - F.col("low") >= F.col("high") - F.col("usual"), F.col("low")).otherwise(F.col("high"))
    off = F.abs(worst - F.col("usual")) * 100 > F.col("usual") * rel.options.frame_rate_pct
    ladder = Window.partitionBy("stream")
    ratio = F.max("usual").over(ladder).cast("double") / F.col("usual")
    whole = F.greatest(F.floor(ratio + 0.5).cast("double"), F.lit(1.0))
    rungs = g.select("stream", "usual", off.alias("off"), (F.abs(ratio - whole) * 100 > whole * rel.options.frame_rate_pct).alias("odd"))
    rungs = rungs.groupBy("stream").agg(F.count("*").alias("n"), _count(F.col("odd")).alias("odd"), _count(F.col("off")).alias("off"), F.max("usual").alias("top")).where("n > 1 AND (odd > 0 OR off = 0)")
    return [
        finding(g.where(off), "profile", "apple:frame-rate", label(), "WARN", worst / 1000),
        finding(rungs, "profile", "apple:frame-rate", of_stream("ladder"), F.when(F.col("odd") > 0, "WARN").otherwise("OK"), F.when(F.col("odd") > 0, F.col("odd")).otherwise(F.col("top") / 1000)),
    ]


#: The rules of each profile; ids are stable. A profile without rules says so.
PROFILES = {"apple": (_apple_peak, _apple_duration, _apple_idr, _apple_tier, _apple_rate), "dash-if": ()}


def profile(rel: Relations) -> DataFrame:
    """Authoring rules beyond correctness, of the profile that the options name."""
    name = rel.options.profile
    streams = rel.renditions.select("stream").distinct()
    if name == "none":
        return finding(streams.where("FALSE"), "profile", "none", of_stream("profile"), "OK")
    if not PROFILES[name]:
        return finding(streams, "profile", f"{name}:not-implemented", of_stream("profile"), "OK")
    return together(*(part for rule in PROFILES[name] for part in rule(rel)))
