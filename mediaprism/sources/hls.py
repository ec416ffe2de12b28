"""HLS playlists as a DataFrame over lines: sticky and pending state become running windows.

Input: manifest_id, body and, where URIs are to be resolved, url. A playlist is read whole by one window over its lines;
many playlists are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.functions.text import attributes, drm_system, hex_iv, hex_section, program_date_time, resolution, resolved, whole_number


# The tags that are read for segments.
_OF_SEGMENTS = ("EXTINF", "EXT-X-BYTERANGE", "EXT-X-PROGRAM-DATE-TIME", "EXT-X-GAP", "EXT-X-DISCONTINUITY", "EXT-X-MAP", "EXT-X-KEY")


def lines(manifests: DataFrame) -> DataFrame:
    """manifest_id, n (line number), line, tag and value of each non-empty line."""
    rows = manifests.select("manifest_id", F.posexplode(F.split(F.replace("body", F.lit("\r"), F.lit("")), "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    tag = F.when(F.col("line").startswith("#EXT"), F.regexp_extract("line", "^#(EXT[A-Z0-9-]*)", 1)).otherwise("")
    return rows.select("*", tag.alias("tag"), F.when(F.col("line").contains(":"), F.substr("line", F.locate(":", "line") + 1)).otherwise("").alias("value"), (~F.col("line").startswith("#")).alias("is_uri"))


def _located(rows: DataFrame, manifests: DataFrame, *columns: str) -> DataFrame:
    """The named URI columns resolved against the playlist's url, if there is one."""
    if "url" not in manifests.columns:
        return rows
    joined = rows.join(manifests.select(F.col("manifest_id").alias("_m"), F.col("url").alias("_url")), F.col("manifest_id") == F.col("_m"), "left")
    return joined.withColumns({c: F.when(F.col(c).isNotNull(), resolved(F.col("_url"), F.col(c))) for c in columns}).drop("_m", "_url")


def playlists(manifests: DataFrame) -> DataFrame:
    """One row per playlist: master or media, live, target duration and the header's numbers."""
    r = lines(manifests)
    number = lambda tag, kind="double": F.max(F.when(F.col("tag") == tag, F.col("value").try_cast(kind)))
    return r.groupBy("manifest_id").agg(
        F.max(F.col("tag") == "EXT-X-STREAM-INF").alias("master"),
        number("EXT-X-TARGETDURATION").alias("target_duration"),
        F.coalesce(number("EXT-X-MEDIA-SEQUENCE", "long"), F.lit(0)).alias("media_sequence"),
        F.coalesce(number("EXT-X-DISCONTINUITY-SEQUENCE", "long"), F.lit(0)).alias("discontinuity_sequence"),
        (~F.max(F.col("tag") == "EXT-X-ENDLIST") & ~F.max(F.col("tag") == "EXT-X-STREAM-INF")).alias("live"),
        F.max(F.when(F.col("tag") == "EXT-X-PART-INF", attributes(F.col("value"))["PART-TARGET"].try_cast("double"))).alias("part_target"),
        F.max(F.when(F.col("tag") == "EXT-X-SERVER-CONTROL", attributes(F.col("value"))["CAN-BLOCK-RELOAD"] == "YES")).alias("can_block_reload"),
    )


def renditions(manifests: DataFrame) -> DataFrame:
    """Variants, I-frame playlists and MEDIA entries with a URI. Names that repeat gain the bandwidth, then a number."""
    r = lines(manifests)
    # A variant waits for the next line that is a URI, whatever comments and tags stand between. From the end on, so that the frame grows by a row each; one that shrinks is added up anew.
    back = Window.partitionBy("manifest_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("next", F.last(F.when(F.col("is_uri"), F.col("line")), ignorenulls=True).over(back)).where("tag IN ('EXT-X-STREAM-INF', 'EXT-X-I-FRAME-STREAM-INF', 'EXT-X-MEDIA')").withColumn("a", attributes(F.col("value")))
    a = lambda k: F.col("a")[k]
    codecs = F.lower(F.coalesce(a("CODECS"), F.lit("")))
    has_video, has_audio = codecs.rlike("avc1|avc3|hvc1|hev1|av01|vp0?9|dvh"), codecs.rlike("mp4a|ac-3|ec-3|opus|flac")
    kind = (
        F.when(F.col("tag") == "EXT-X-I-FRAME-STREAM-INF", "iframe")
        .when(F.col("tag") == "EXT-X-MEDIA", F.when(a("TYPE") == "AUDIO", "audio").when(a("TYPE") == "SUBTITLES", "text").when(a("TYPE") == "VIDEO", "video"))
        .when(has_audio & ~has_video, "audio")
        .otherwise("video")
    )
    size = resolution(F.coalesce(a("RESOLUTION"), F.lit("")))
    out = r.select(
        "manifest_id",
        "n",
        kind.alias("kind"),
        F.when(F.col("tag") == "EXT-X-STREAM-INF", F.col("next")).otherwise(a("URI")).alias("uri"),
        F.coalesce(a("BANDWIDTH").try_cast("long"), F.lit(0)).alias("bandwidth"),
        F.coalesce(a("AVERAGE-BANDWIDTH").try_cast("long"), F.lit(0)).alias("avg_bandwidth"),
        size["width"].alias("width"),
        size["height"].alias("height"),
        F.coalesce(a("CODECS"), F.lit("")).alias("codecs"),
        a("FRAME-RATE").try_cast("double").alias("frame_rate"),
        a("VIDEO-RANGE").alias("video_range"),
        a("AUDIO").alias("audio_group"),
        a("GROUP-ID").alias("group_id"),
        a("LANGUAGE").alias("language"),
        F.when(a("CHANNELS").contains("/"), 0).otherwise(a("CHANNELS").try_cast("int")).alias("channels"),
        (a("CLOSED-CAPTIONS") == "NONE").alias("captions_none"),
        a("CLOSED-CAPTIONS").alias("captions_group"),
        F.coalesce(a("NAME"), F.when(size["height"] > 0, F.concat(size["height"].cast("string"), F.lit("p"))).when(a("BANDWIDTH").isNotNull(), F.concat(F.floor(a("BANDWIDTH").try_cast("long") / 1000).cast("string"), F.lit("kbps"))).otherwise("variant")).alias("name"),
    ).where("uri IS NOT NULL AND kind IS NOT NULL")
    same = Window.partitionBy("manifest_id", "name")
    out = out.withColumn("name", F.when(F.count("*").over(same) > 1, F.concat_ws(" ", "name", F.concat(F.floor(F.col("bandwidth") / 1000).cast("string"), F.lit("kbps")))).otherwise(F.col("name")))
    nth = F.row_number().over(same.orderBy("n"))
    out = _located(out, manifests, "uri")
    return out.withColumn("name", F.when((F.count("*").over(same) > 1) & (nth > 1), F.concat(F.col("name"), F.lit(" #"), nth.cast("string"))).otherwise(F.col("name")))


def captions(manifests: DataFrame) -> DataFrame:
    """CLOSED-CAPTIONS groups: manifest_id, group_id, instream_ids."""
    r = lines(manifests).where("tag = 'EXT-X-MEDIA'").withColumn("a", attributes(F.col("value"))).where("a['TYPE'] = 'CLOSED-CAPTIONS'")
    return r.groupBy("manifest_id", F.col("a")["GROUP-ID"].alias("group_id")).agg(F.array_sort(F.collect_set(F.col("a")["INSTREAM-ID"])).alias("instream_ids"))


def with_captions(found: DataFrame, manifests: DataFrame) -> DataFrame:
    """Renditions with the INSTREAM-IDs that their captions group declares; an empty list where there are none."""
    c = captions(manifests).withColumnsRenamed({"manifest_id": "_m", "group_id": "_g"})
    joined = found.join(c, (F.col("manifest_id") == F.col("_m")) & (F.col("captions_group") == F.col("_g")), "left")
    return joined.withColumn("caption_ids", F.coalesce("instream_ids", F.array().cast("array<string>"))).drop("_m", "_g", "instream_ids")


def _numbered(manifests: DataFrame) -> DataFrame:
    """Lines with the number of the segment that each belongs to: how many URI lines stand before it."""
    by_line = Window.partitionBy("manifest_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    head = playlists(manifests).select("manifest_id", "media_sequence", "live", "master").where("NOT master")
    return lines(manifests).withColumn("segment", F.coalesce(F.sum(F.col("is_uri").cast("int")).over(by_line), F.lit(0))).join(head, "manifest_id")


def _ranges(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """``offset`` and ``length`` of byte ranges; one without an offset goes on after the one before of the same URI, else begins at 0."""
    r = rows.withColumns({"length": whole_number(text, r"^(\d+)"), "_stated": whole_number(text, r"@(\d+)$")})
    same = Window.partitionBy("manifest_id", "uri").orderBy(order)
    r = r.withColumn("_island", F.sum(F.when(F.col("_stated").isNotNull() | F.col("length").isNull(), 1).otherwise(0)).over(same))
    inside = Window.partitionBy("manifest_id", "uri", "_island").orderBy(order)
    return r.withColumn("offset", F.when(F.col("length").isNotNull(), F.coalesce(F.first("_stated").over(inside), F.lit(0)) + F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))).drop("_stated", "_island")


def parts(manifests: DataFrame) -> DataFrame:
    """Low-latency parts: sequence of their segment, idx in it, uri, duration, byte range, independent, gap."""
    r = _numbered(manifests).where("tag = 'EXT-X-PART'").withColumn("a", attributes(F.col("value")))
    r = _ranges(r.withColumn("uri", F.col("a")["URI"]), "n", F.col("a")["BYTERANGE"])
    idx = F.row_number().over(Window.partitionBy("manifest_id", "segment").orderBy("n")) - 1
    out = r.select("manifest_id", (F.col("segment") + F.col("media_sequence")).alias("sequence"), idx.alias("idx"), "uri", F.col("a")["DURATION"].try_cast("double").alias("duration"), F.when(F.col("length").isNotNull(), F.struct("offset", "length")).alias("byte_range"), F.coalesce(F.col("a")["INDEPENDENT"] == "YES", F.lit(False)).alias("independent"), F.coalesce(F.col("a")["GAP"] == "YES", F.lit(False)).alias("gap"))
    return _located(out, manifests, "uri")


def preload_hints(manifests: DataFrame) -> DataFrame:
    """What a live playlist says will come next: kind, uri and where it starts."""
    a = attributes(F.col("value"))
    r = _numbered(manifests).where("tag = 'EXT-X-PRELOAD-HINT'").select("manifest_id", (F.col("segment") + F.col("media_sequence")).alias("sequence"), F.lower(a["TYPE"]).alias("kind"), a["URI"].alias("uri"), F.coalesce(a["BYTERANGE-START"].try_cast("long"), F.lit(0)).alias("offset"), a["BYTERANGE-LENGTH"].try_cast("long").alias("length"))
    return _located(r, manifests, "uri")


def ad_breaks(manifests: DataFrame) -> DataFrame:
    """Declared breaks: tag, id, out_of_network, start (wall clock), at_sequence (of the next segment), duration, section (bytes).

    Date ranges count where they carry a splice section; CUE-OUT and CUE-IN stand at the next segment, CUE-OUT-CONT says nothing new.
    """
    a = F.when(F.col("tag") == "EXT-X-DATERANGE", attributes(F.col("value")))
    r = _numbered(manifests).where("tag IN ('EXT-X-DATERANGE', 'EXT-X-CUE-OUT', 'EXT-X-CUE-IN')").withColumn("a", a)
    hexed = F.coalesce(F.col("a")["SCTE35-OUT"], F.col("a")["SCTE35-IN"], F.col("a")["SCTE35-CMD"])
    ranged = F.col("tag") == "EXT-X-DATERANGE"
    said = F.regexp_extract("value", r"(?:^|DURATION=)\s*([0-9.]+)", 1).try_cast("double")
    return r.where(~ranged | hexed.isNotNull()).select(
        "manifest_id",
        F.replace("tag", F.lit("EXT-X-"), F.lit("")).alias("tag"),
        F.col("a")["ID"].alias("id"),
        F.when(ranged, F.col("a")["SCTE35-OUT"].isNotNull()).otherwise(F.col("tag") == "EXT-X-CUE-OUT").alias("out_of_network"),
        program_date_time(F.col("a")["START-DATE"]).alias("start"),
        F.when(~ranged, F.col("segment") + F.col("media_sequence")).alias("at_sequence"),
        F.when(ranged, F.coalesce(F.col("a")["DURATION"], F.col("a")["PLANNED-DURATION"]).try_cast("double")).otherwise(said).alias("duration"),
        hex_section(hexed).alias("section"),
    )


def key_systems(manifests: DataFrame) -> DataFrame:
    """manifest_id and the key formats that any of a playlist's keys name, session keys among them; plain keys name none."""
    a = attributes(F.col("value"))
    keys = lines(manifests).where("tag IN ('EXT-X-KEY', 'EXT-X-SESSION-KEY')").select("manifest_id", a["METHOD"].alias("method"), drm_system(a["KEYFORMAT"]).alias("system"))
    # Sample encryption by whole blocks is one scheme, by counter the other.
    scheme = F.when(F.upper("method") == "SAMPLE-AES-CTR", "cenc").when(F.upper("method") == "SAMPLE-AES", "cbcs")
    return keys.groupBy("manifest_id").agg(F.array_sort(F.collect_set("system")).alias("systems"), F.min(scheme).alias("scheme"))


def segments(manifests: DataFrame) -> DataFrame:
    """Media segments in order, with sticky MAP and KEY, pending tags, byte ranges and wall clocks carried on."""
    # Lines that say nothing about segments are left out before they are sorted.
    r = lines(manifests).where(F.col("is_uri") | F.col("tag").isin(*_OF_SEGMENTS))
    by_line = Window.partitionBy("manifest_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda tag: F.col("tag") == tag
    carried = lambda c: F.last(c, ignorenulls=True).over(by_line)
    r = r.withColumn("a", F.when(at("EXT-X-MAP") | at("EXT-X-KEY"), attributes(F.col("value"))))
    key = F.when(at("EXT-X-KEY"), F.struct(*[F.col("a")[k].alias(k.lower()) for k in ("METHOD", "URI", "IV", "KEYFORMAT")]))
    r = r.select(
        "*",
        (F.sum(F.col("is_uri").cast("int")).over(by_line) - F.col("is_uri").cast("int")).alias("segment"),
        carried(F.when(at("EXT-X-MAP"), F.struct(F.col("a")["URI"].alias("uri"), F.col("a")["BYTERANGE"].alias("range")))).alias("map"),
        carried(key).alias("key"),
        F.sum(at("EXT-X-DISCONTINUITY").cast("int")).over(by_line).alias("discontinuities"),
    )
    pending = lambda tag: F.max_by(F.when(at(tag), F.col("value")), F.when(at(tag), F.col("n")))
    s = r.groupBy("manifest_id", "segment").agg(
        F.max(F.when(F.col("is_uri"), F.col("line"))).alias("uri"),
        F.regexp_extract(pending("EXTINF"), r"^\s*([0-9.]+)", 1).try_cast("double").alias("duration"),
        F.max(at("EXT-X-DISCONTINUITY")).alias("discontinuity"),
        pending("EXT-X-BYTERANGE").alias("range"),
        pending("EXT-X-PROGRAM-DATE-TIME").alias("stated"),
        F.max(at("EXT-X-GAP")).alias("gap"),
        F.max_by("map", F.when(F.col("is_uri"), F.col("n"))).alias("map"),
        F.max_by("key", F.when(F.col("is_uri"), F.col("n"))).alias("key"),
        F.max("discontinuities").alias("discontinuities"),
    ).where("uri IS NOT NULL")
    head = playlists(manifests).select("manifest_id", "media_sequence", F.col("discontinuity_sequence").alias("first_ds"), "live", "master").where("NOT master")
    s = s.join(head, "manifest_id")
    order = Window.partitionBy("manifest_id").orderBy("segment")
    s = s.withColumn("pdt_stated", program_date_time(F.col("stated")))
    s = _ranges(s, "segment", F.col("range"))
    # Wall clocks likewise: an anchor or a discontinuity begins an island, durations add up in it.
    s = s.withColumn("clock", F.sum(F.when(F.col("pdt_stated").isNotNull() | F.col("discontinuity"), 1).otherwise(0)).over(order))
    since = Window.partitionBy("manifest_id", "clock").orderBy("segment")
    anchor = F.first("pdt_stated").over(since)
    passed = F.coalesce(F.sum(F.round(F.col("duration") * 1_000_000).cast("long")).over(since.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.upper(F.coalesce(F.col("key.method"), F.lit("NONE"))) == "NONE"
    keyed = lambda c: F.when(~none, c)
    out = s.select(
        "manifest_id",
        (F.row_number().over(order) - 1 + F.col("media_sequence")).alias("sequence"),
        "uri",
        "duration",
        "discontinuity",
        (F.col("first_ds") + F.col("discontinuities")).alias("discontinuity_sequence"),
        F.when(F.col("length").isNotNull(), F.struct("offset", "length")).alias("byte_range"),
        F.col("map.uri").alias("init_uri"),
        # A map's range without an offset begins at 0.
        F.when(F.col("map.range") != "", F.struct(F.coalesce(whole_number(F.col("map.range"), r"@(\d+)"), F.lit(0)).alias("offset"), whole_number(F.col("map.range"), r"^(\d+)").alias("length"))).alias("init_range"),
        F.timestamp_micros(F.unix_micros(anchor) + passed).alias("pdt"),
        (F.col("pdt_stated").isNull() & anchor.isNotNull()).alias("pdt_derived"),
        keyed(F.col("key.method")).alias("key_method"),
        keyed(F.col("key.uri")).alias("key_uri"),
        keyed(hex_iv(F.col("key.iv"))).alias("key_iv"),
        keyed(F.coalesce("key.keyformat", F.lit("identity"))).alias("key_format"),
        "gap",
        "live",
    )
    return _located(out, manifests, "uri", "init_uri", "key_uri")


def kind_of(url: Column, content_type: Column, body: Column) -> Column:
    """``dash`` or ``hls``: by extension, content type, the body's start, else HLS."""
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    kind = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return (
        F.when(path.endswith(".mpd"), "dash").when(path.rlike(r"\.m3u8?$"), "hls").when(kind == "application/dash+xml", "dash").when(kind.isin("application/vnd.apple.mpegurl", "application/x-mpegurl", "audio/mpegurl"), "hls")
        .when(F.lower(F.substring(body, 1, 512)).contains("<mpd"), "dash").otherwise("hls")
    )
