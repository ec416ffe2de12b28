"""Manifests written from the ``events`` table, and what they say as plain SQL, to hold the readers against.

Each user of the table is a rendition, each of its events a segment; what a segment is given depends on
the event's number alone, so both engines know it without reading the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EVENTS = "(SELECT user_id AS u, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_EVENTS.replace('events)', '{events})')} e", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _bodies(rows: DataFrame, head: str, tail: str = "") -> DataFrame:
    """manifest_id, url, body from rows of u, n, line."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(F.col("u").alias("manifest_id")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("body")).withColumn("url", F.concat(F.lit("https://cdn.example/a/"), F.col("manifest_id").cast("string"), F.lit("/live/index.m3u8?token=1")))


def _when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def media_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLS media playlists with discontinuities, keys, maps, clocks, ranges, parts, cues and date ranges."""
    line = ", ".join([
        "CASE WHEN i % 5 = 2 THEN '# a comment, then #EXTINF in it' END",
        _when("i % 11 = 0", "'#EXT-X-DISCONTINUITY'"),
        _when("i % 13 = 0", "concat('#EXT-X-KEY:METHOD=AES-128,URI=\"../k', i, '\",IV=0x', lpad(hex(i), 32, '0'))"),
        _when("i % 17 = 0", "'#EXT-X-KEY:METHOD=NONE'"),
        _when("n % 10 = 1", "concat('#EXT-X-MAP:URI=\"/init', n, '.mp4\"')"),
        _when("i % 7 = 0", "concat('#EXT-X-PROGRAM-DATE-TIME:', date_format(timestamp_seconds(1704067200 + n * 2), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\"))"),
        _when("i % 19 = 0", "concat('#EXT-X-CUE-OUT:DURATION=', n)"),
        _when("i % 19 = 1", "'#EXT-X-CUE-OUT-CONT:1/2'"),
        _when("i % 19 = 2", "'#EXT-X-CUE-IN'"),
        _when("i % 23 = 0", "concat('#EXT-X-DATERANGE:ID=\"d', i, '\",START-DATE=\"', date_format(timestamp_seconds(1704067200 + n * 3), \"yyyy-MM-dd'T'HH:mm:ssXXX\"), '\",PLANNED-DURATION=', n, '.5,SCTE35-OUT=0xFC', lpad(hex(i), 8, '0'))"),
        _when("i % 29 = 0", "'#EXT-X-DATERANGE:ID=\"no section\",START-DATE=\"2024-01-01T00:00:00Z\"'"),
        _when("u % 2 = 0 AND n % 4 = 0", "concat('#EXT-X-PART:DURATION=0.5,URI=\"p', n, '.m4s\",INDEPENDENT=YES,BYTERANGE=\"', 100 + i % 9, '@40\"')"),
        _when("u % 2 = 0 AND n % 4 = 0", "concat('#EXT-X-PART:DURATION=0.25,URI=\"p', n, '.m4s\",BYTERANGE=\"', 7 + i % 9, '\"', CASE WHEN i % 2 = 0 THEN ',GAP=YES' ELSE '' END)"),
        "concat('#EXTINF:', CASE WHEN i % 5 = 0 THEN '2.5' ELSE '2.0' END, ',title, with a comma')",
        _when("i % 3 = 0", "concat('#EXT-X-BYTERANGE:', 100 + i % 50, CASE WHEN i % 6 = 0 THEN concat('@', 1000 * n) ELSE '' END)"),
        _when("i % 31 = 0", "'#EXT-X-GAP'"),
        "CASE WHEN i % 3 = 0 THEN concat('f', CAST(floor(n / 8) AS INT), '.mp4') ELSE concat('s', n, '.ts') END",
    ])
    rows = _events(spark, sf_dir).selectExpr("u", "n", f"array_join(array_compact(array({line})), '\n') AS line")
    head = "#EXTM3U\r\n#EXT-X-TARGETDURATION:3\r\n#EXT-X-MEDIA-SEQUENCE:5\n#EXT-X-DISCONTINUITY-SEQUENCE:2\n#EXT-X-PART-INF:PART-TARGET=0.5\n"
    return _bodies(rows, head, "\n#EXT-X-PRELOAD-HINT:TYPE=PART,URI=\"next.m4s\",BYTERANGE-START=12\n")


def master_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HLS master playlists: a variant for each of a user's first eight events, with audio, captions and comments between tag and URI."""
    lines = """array_join(array_compact(array(
      CASE WHEN i % 4 = 0 THEN concat('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID=\"aud', n % 2, '\",NAME=\"track ', i, ', stereo\",LANGUAGE=\"en\",CHANNELS=\"', CASE WHEN i % 8 = 0 THEN '16/JOC' ELSE '2' END, '\"', CASE WHEN i % 12 = 0 THEN '' ELSE concat(',URI=\"audio/', i, '.m3u8\"') END) END,
      CASE WHEN i % 3 = 0 THEN concat('#EXT-X-MEDIA:TYPE=CLOSED-CAPTIONS,GROUP-ID=\"cc', n % 2, '\",NAME=\"c\",INSTREAM-ID=\"', CASE WHEN i % 2 = 0 THEN 'CC1' ELSE 'SERVICE1' END, '\"') END,
      concat('#EXT-X-STREAM-INF:BANDWIDTH=', 100000 + (i % 7) * 1000, CASE WHEN i % 5 = 0 THEN '' ELSE concat(',RESOLUTION=', 16 * (i % 3 + 1), 'x', 9 * (i % 3 + 1)) END, ',CODECS=\"', CASE WHEN i % 6 = 1 THEN 'mp4a.40.2' ELSE 'avc1.64001f,mp4a.40.2' END, '\",CLOSED-CAPTIONS=', CASE WHEN i % 9 = 0 THEN 'NONE' ELSE concat('\"cc', n % 2, '\"') END, ',FRAME-RATE=', 25 + i % 2, '.000'),
      CASE WHEN i % 2 = 0 THEN '# comment before the URI' END,
      CASE WHEN i % 10 = 0 THEN '#EXT-X-UNKNOWN:X=1' END,
      concat('v/', i, '.m3u8'))), '\n') AS line"""
    return _bodies(_events(spark, sf_dir).where("n <= 8").selectExpr("u", "n", lines), "#EXTM3U\n")


def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DASH manifests of three periods a user: a numbered template, a timeline with a repeat to the end, and lists, indexes and plain files."""
    body = """concat('<MPD type=\"static\" mediaPresentationDuration=\"PT', 60 + m, 'S\"><BaseURL>https://cdn.example/b', u, '/</BaseURL>',
      '<Period id=\"p0\" duration=\"PT20S\"><BaseURL>one/</BaseURL><AdaptationSet contentType=\"video\" codecs=\"avc1.64001f\"><ContentProtection schemeIdUri=\"urn:mpeg:dash:mp4protection:2011\" value=\"', CASE WHEN u % 2 = 0 THEN 'cenc' ELSE 'cbcs' END, '\"/><ContentProtection schemeIdUri=\"urn:uuid:EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED\"', CASE WHEN u % 3 = 0 THEN '><cenc:pssh xmlns:cenc=\"urn:mpeg:cenc:2013\">AAAA</cenc:pssh></ContentProtection>' ELSE '/>' END,
      '<Accessibility schemeIdUri=\"urn:scte:dash:cc:cea-608:2015\" value=\"CC1=eng;CC3=deu\"/>',
      '<SegmentTemplate media=\"$RepresentationID$/$Number%05d$-$$.m4s\" initialization=\"$RepresentationID$.mp4\" timescale=\"1000\" duration=\"', 3000 + u % 4 * 1000, '\" startNumber=\"', u % 5, '\"/>',
      '<Representation id=\"v', u, '\" bandwidth=\"', 1000 + u, '\" width=\"640\" height=\"360\" frameRate=\"30000/1001\"/></AdaptationSet></Period>',
      '<Period id=\"p1\" duration=\"PT', 10 + u % 3, 'S\"><EventStream schemeIdUri=\"urn:scte:scte35:2013:bin\" timescale=\"10\"><Event id=\"', u, '\" presentationTime=\"', u % 7, '\" duration=\"50\"/></EventStream><AdaptationSet mimeType=\"audio/mp4\" lang=\"en\"><AudioChannelConfiguration schemeIdUri=\"urn:mpeg:dash:23003:3:audio_channel_configuration:2011\" value=\"6\"/><BaseURL>../x/</BaseURL><SegmentTemplate media=\"a-$Time$-$Bandwidth$.m4s\" timescale=\"100\" presentationTimeOffset=\"', u % 2 * 100, '\"><SegmentTimeline><S t=\"', u % 2 * 100, '\" d=\"200\" r=\"', u % 3, '\"/><S d=\"0\"/><S d=\"150\" r=\"-1\"/></SegmentTimeline></SegmentTemplate><Representation id=\"a\" bandwidth=\"5\"/></AdaptationSet></Period>',
      '<Period id=\"p2\"><AdaptationSet contentType=\"video\"><Representation id=\"l\" bandwidth=\"7\" height=\"9\"><SegmentList duration=\"4\"><Initialization sourceURL=\"li.mp4\" range=\"0-99\"/><SegmentURL media=\"l1.m4s\"/><SegmentURL media=\"https://other.example/l2.m4s\" mediaRange=\"100-', 149 + u, '\"/></SegmentList></Representation>',
      '<Representation id=\"b\" bandwidth=\"8\"><BaseURL>whole', u, '.mp4</BaseURL><SegmentBase indexRange=\"600-', 700 + u, '\"><Initialization range=\"0-599\"/></SegmentBase></Representation></AdaptationSet>',
      '<AdaptationSet mimeType=\"text/vtt\"><Representation id=\"t\" bandwidth=\"1\"><BaseURL>side.vtt</BaseURL></Representation></AdaptationSet></Period></MPD>') AS body"""
    users = _events(spark, sf_dir).groupBy("u").agg(F.count("*").alias("m"))
    return users.selectExpr("u AS manifest_id", body, "'https://start.example/m/manifest.mpd' AS url")


_BASE = "'https://cdn.example/a/' || u || '/live/'"

SQL: dict[str, str] = {
    "hls_segments": f"""WITH e AS (SELECT *, CASE WHEN i % 3 = 0 THEN 'f' || CAST(floor(n / 8) AS INT) || '.mp4' ELSE 's' || n || '.ts' END AS name, CASE WHEN i % 3 = 0 THEN 100 + i % 50 END AS length, CASE WHEN i % 6 = 0 THEN 1000 * n END AS stated,
  CASE WHEN i % 17 = 0 THEN 0 WHEN i % 13 = 0 THEN i END AS k, CASE WHEN n % 10 = 1 THEN n END AS ini, CASE WHEN i % 5 = 0 THEN 2.5 ELSE 2.0 END AS d, CASE WHEN i % 7 = 0 THEN 1704067200000000 + n * 2000000 END AS pdt FROM {_EVENTS} e),
f AS (SELECT *, sum(CASE WHEN stated IS NOT NULL OR length IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY u, name ORDER BY n) AS isl, sum(CASE WHEN pdt IS NOT NULL OR i % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY n) AS clk,
  sum(CASE WHEN i % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY n) AS ds, last_value(k IGNORE NULLS) OVER (PARTITION BY u ORDER BY n) AS key, last_value(ini IGNORE NULLS) OVER (PARTITION BY u ORDER BY n) AS mp FROM e)
SELECT u AS manifest_id, CAST(4 + n AS BIGINT) AS sequence, {_BASE} || name AS uri, CAST(d AS DOUBLE) AS duration, i % 11 = 0 AS discontinuity, CAST(2 + ds AS BIGINT) AS discontinuity_sequence,
  CASE WHEN length IS NOT NULL THEN coalesce(first_value(stated) OVER w, 0) + sum(length) OVER w - length END::DOUBLE AS range_offset, CAST(length AS DOUBLE) AS range_length, 'https://cdn.example/init' || mp || '.mp4' AS init_uri,
  (first_value(pdt) OVER c + CAST(round(sum(d) OVER c - d, 1) * 1000000 AS BIGINT))::DOUBLE AS pdt_us, coalesce(pdt IS NULL AND first_value(pdt) OVER c IS NOT NULL, FALSE) AS pdt_derived,
  CASE WHEN key > 0 THEN 'AES-128' END AS key_method, CASE WHEN key > 0 THEN 'https://cdn.example/a/' || u || '/k' || key END AS key_uri, CASE WHEN key > 0 THEN lpad(hex(key), 32, '0') END AS key_iv, i % 31 = 0 AS gap
FROM f WINDOW w AS (PARTITION BY u, name, isl ORDER BY n), c AS (PARTITION BY u, clk ORDER BY n)""",
    "hls_parts": f"""SELECT u AS manifest_id, CAST(4 + n AS BIGINT) AS sequence, CAST(k AS BIGINT) AS idx, {_BASE} || 'p' || n || '.m4s' AS uri, CASE WHEN k = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS duration,
  CAST(CASE WHEN k = 0 THEN 40 ELSE 140 + i % 9 END AS BIGINT) AS range_offset, CAST(CASE WHEN k = 0 THEN 100 ELSE 7 END + i % 9 AS BIGINT) AS range_length, k = 0 AS independent, k = 1 AND i % 2 = 0 AS gap
FROM {_EVENTS} e CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE u % 2 = 0 AND n % 4 = 0""",
    "hls_breaks": f"""SELECT u AS manifest_id, 'CUE-OUT' AS tag, CAST(NULL AS VARCHAR) AS id, TRUE AS out_of_network, CAST(NULL AS DOUBLE) AS start_us, CAST(4 + n AS DOUBLE) AS at_sequence, CAST(n AS DOUBLE) AS duration, CAST(NULL AS VARCHAR) AS section FROM {_EVENTS} e WHERE i % 19 = 0
UNION ALL SELECT u, 'CUE-IN', NULL, FALSE, NULL, 4 + n, NULL, NULL FROM {_EVENTS} e WHERE i % 19 = 2
UNION ALL SELECT u, 'DATERANGE', 'd' || i, TRUE, 1704067200000000 + n * 3000000, NULL, n + 0.5, 'FC' || lpad(hex(i), 8, '0') FROM {_EVENTS} e WHERE i % 23 = 0""",
    "hls_playlists": f"""SELECT u AS manifest_id, FALSE AS master, TRUE AS live, CAST(3 AS DOUBLE) AS target_duration, CAST(5 AS BIGINT) AS media_sequence, CAST(2 AS BIGINT) AS discontinuity_sequence, CAST(0.5 AS DOUBLE) AS part_target, {_BASE} || 'next.m4s' AS hint, CAST(12 AS BIGINT) AS hint_offset, CAST(5 + count(*) AS BIGINT) AS hint_sequence FROM {_EVENTS} e GROUP BY u""",
    "hls_renditions": f"""WITH e AS (SELECT * FROM {_EVENTS} e WHERE n <= 8),
cap AS (SELECT u AS cu, n % 2 AS g, string_agg(DISTINCT CASE WHEN i % 2 = 0 THEN 'CC1' ELSE 'SERVICE1' END, ',' ORDER BY CASE WHEN i % 2 = 0 THEN 'CC1' ELSE 'SERVICE1' END) AS ids FROM e WHERE i % 3 = 0 GROUP BY 1, 2),
v AS (SELECT u, n * 10 + 5 AS o, CASE WHEN i % 6 = 1 THEN 'audio' ELSE 'video' END AS kind, {_BASE} || 'v/' || i || '.m3u8' AS uri, 100000 + (i % 7) * 1000 AS bw, CASE WHEN i % 5 = 0 THEN 0 ELSE 16 * (i % 3 + 1) END AS width, CASE WHEN i % 5 = 0 THEN 0 ELSE 9 * (i % 3 + 1) END AS height,
    25.0 + i % 2 AS fps, NULL AS channels, i % 9 = 0 AS none, CASE WHEN i % 9 = 0 THEN '' ELSE coalesce(ids, '') END AS captions, CASE WHEN i % 5 = 0 THEN (100000 + (i % 7) * 1000) // 1000 || 'kbps' ELSE 9 * (i % 3 + 1) || 'p' END AS base FROM e LEFT JOIN cap ON cu = u AND g = n % 2
  UNION ALL SELECT u, n * 10, 'audio', {_BASE} || 'audio/' || i || '.m3u8', 0, 0, 0, NULL, CASE WHEN i % 8 = 0 THEN 0 ELSE 2 END, NULL, '', 'track ' || i || ', stereo' FROM e WHERE i % 4 = 0 AND i % 12 <> 0),
w AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY u, base) > 1 THEN base || ' ' || bw // 1000 || 'kbps' ELSE base END AS named FROM v)
SELECT u AS manifest_id, kind, uri, CAST(bw AS BIGINT) AS bandwidth, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST(fps AS DOUBLE) AS frame_rate, CAST(channels AS DOUBLE) AS channels, coalesce(none, FALSE) AS captions_none, captions,
  CASE WHEN row_number() OVER (PARTITION BY u, named ORDER BY o) > 1 THEN named || ' #' || row_number() OVER (PARTITION BY u, named ORDER BY o) ELSE named END AS name FROM w""",
    "dash_segments": f"""WITH d AS (SELECT u, 3000 + u % 4 * 1000 AS ms, 10 + u % 3 AS p1, count(*) + 60 AS total FROM {_EVENTS} e GROUP BY u),
n AS (SELECT *, unnest(range(0, CAST(ceil(20000 / ms) AS BIGINT))) AS k FROM d),
t AS (SELECT u, p1, k, k * 200 AS pos, 200 AS len FROM (SELECT *, unnest(range(0, u % 3 + 1)) AS k FROM d) UNION ALL
  SELECT u, p1, u % 3 + 1 + k, (u % 3 + 1) * 200 + k * 150, 150 FROM (SELECT *, unnest(range(0, greatest((p1 * 100 - (u % 3 + 1) * 200) // 150, 1))) AS k FROM d))
SELECT u AS manifest_id, 0 AS period_index, 'v' || u AS rep_id, CAST(u % 5 + k AS BIGINT) AS sequence, 'https://cdn.example/b' || u || '/one/v' || u || '/' || lpad(CAST(u % 5 + k AS VARCHAR), 5, '0') || '-$.m4s' AS uri, 'https://cdn.example/b' || u || '/one/v' || u || '.mp4' AS init_uri, ms / CAST(1000 AS DOUBLE) AS duration, k * ms / CAST(1000 AS DOUBLE) AS declared_start, CAST(NULL AS DOUBLE) AS range_offset, CAST(NULL AS DOUBLE) AS range_length FROM n
UNION ALL SELECT u, 1, 'a', 1 + k, 'https://cdn.example/x/a-' || (pos + u % 2 * 100) || '-5.m4s', NULL, len / CAST(100 AS DOUBLE), 20 + pos / CAST(100 AS DOUBLE), NULL, NULL FROM t
UNION ALL SELECT u, 2, 'l', 1, 'https://cdn.example/b' || u || '/l1.m4s', 'https://cdn.example/b' || u || '/li.mp4', 4, 20 + p1, NULL, NULL FROM d
UNION ALL SELECT u, 2, 'l', 2, 'https://other.example/l2.m4s', 'https://cdn.example/b' || u || '/li.mp4', 4, 24 + p1, 100, 50 + u FROM d
UNION ALL SELECT u, 2, 't', 1, 'https://cdn.example/b' || u || '/side.vtt', NULL, total - 20 - p1, 20 + p1, NULL, NULL FROM d""",
    "dash_representations": f"""WITH d AS (SELECT DISTINCT u FROM {_EVENTS} e)
SELECT u AS manifest_id, 0 AS period_index, 'v' || u AS rep_id, 'video' AS kind, CAST(640 AS DOUBLE) AS width, 30000 / CAST(1001 AS DOUBLE) AS frame_rate, CAST(NULL AS DOUBLE) AS channels, CASE WHEN u % 2 = 0 THEN 'cenc' ELSE 'cbcs' END AS scheme, 'edef8ba9-79d6-4ace-a3c8-27dcd51d21ed' AS systems, CASE WHEN u % 3 = 0 THEN 'edef8ba9-79d6-4ace-a3c8-27dcd51d21ed' ELSE '' END AS inline_systems, 'CC1,CC3' AS captions, 'template' AS addressing, CAST(NULL AS VARCHAR) AS index_range FROM d
UNION ALL SELECT u, 1, 'a', 'audio', NULL, NULL, 6, NULL, '', '', '', 'template', NULL FROM d
UNION ALL SELECT u, 2, 'l', 'video', NULL, NULL, NULL, NULL, '', '', '', 'list', NULL FROM d
UNION ALL SELECT u, 2, 'b', 'video', NULL, NULL, NULL, NULL, '', '', '', 'index', '600-' || (700 + u) FROM d
UNION ALL SELECT u, 2, 't', 'text', NULL, NULL, NULL, NULL, '', '', '', 'file', NULL FROM d""",
    "dash_events": f"""SELECT DISTINCT u AS manifest_id, 1 AS period_index, 'urn:scte:scte35:2013:bin' AS scheme, CAST(u AS VARCHAR) AS id, CAST(20 + (u % 7) / CAST(10 AS DOUBLE) AS DOUBLE) AS start, CAST(5 AS DOUBLE) AS duration FROM {_EVENTS} e""",
}
