"""Streams made from the ``events`` table as bytes, with defects planted by event number, and what is to be measured in them as SQL.

Each user is a rendition of one of two master playlists, whose clocks are 100 s apart, each event a transport stream segment of ten pictures.
The SQL says what a reader must find, so it can be given to the checks' own SQL in place of the
projected relations.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.storage import saved, spread

PICTURES, STEP, CLOCK = 10, 18_000, 90_000
_SITE = "https://cdn.example/live"
_EVENTS = "(SELECT user_id AS u, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


class _Bits:
    def __init__(self):
        self.bits = []

    def put(self, width: int, value: int) -> _Bits:
        self.bits += [value >> k & 1 for k in reversed(range(width))]
        return self

    def ue(self, value: int) -> _Bits:
        width = (value + 1).bit_length()
        return self.put(2 * width - 1, value + 1)

    def bytes(self) -> bytes:
        padded = [*self.bits, 1]
        padded += [0] * (-len(padded) % 8)
        return bytes(sum(b << 7 - k for k, b in enumerate(padded[i : i + 8])) for i in range(0, len(padded), 8))


@functools.cache
def parameter_set(width: int, height: int) -> bytes:
    """An AVC main profile set, level 3.1; sizes are multiples of 16."""
    raw = _Bits().put(8, 77).put(8, 0).put(8, 31).ue(0).ue(0).ue(2).ue(1).put(1, 0).ue(width // 16 - 1).ue(height // 16 - 1).put(4, 0b1100).bytes()
    out = bytearray(b"\x67")
    for b in raw:
        if b <= 3 and out[-2:] == b"\0\0":
            out.append(3)
        out.append(b)
    return bytes(out)


def _packet(pid: int, start: bool, counter: int, payload: bytes) -> bytes:
    fill = 184 - len(payload)
    field = b"" if not fill else b"\0" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if fill else 0x10) | counter]) + field + payload


def _section(table: int, number: int, body: bytes) -> bytes:
    size = len(body) + 9
    return bytes([0, table, 0xB0 | size >> 8, size & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body + bytes(4)


def segment(start: int, width: int, height: int, idr: int | None, lost: int | None) -> bytes:
    """One segment; ``idr``: the picture that is a keyframe, ``lost``: the one whose packet is left out."""
    out = _packet(0, True, 0, _section(0, 1, b"\0\1\xe1\0")) + _packet(256, True, 0, _section(2, 1, b"\xe1\1\xf0\0\x1b\xe1\1\xf0\0"))
    for k in range(PICTURES):
        pts = (start + k * STEP) % (1 << 33)
        stamp = bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
        unit = (b"\0\0\1" + parameter_set(width, height) if k == 0 else b"") + b"\0\0\1" + (b"\x65" if k == idr else b"\x41") + b"\x88" * 40
        if k != lost:
            out += _packet(257, True, k & 15, b"\0\0\1\xe0\0\0\x80\x80\5" + stamp + unit)
    return out


#: What each segment is given, by its user's number u, its own number i and its place n; for both engines.
_GIVEN = """900000 + u % 2 * 9000000 + (n - 1) * 180000 + CASE WHEN i % 97 = 0 THEN 27000 ELSE 0 END AS start,
  CASE WHEN i % 103 = 0 THEN 640 ELSE 320 + (u % 6) * 16 END AS width, CASE WHEN i % 103 = 0 THEN 352 ELSE 176 + (u % 6) * 16 END AS height,
  CASE WHEN i % 113 = 0 THEN NULL WHEN i % 13 = 0 THEN 4 ELSE 0 END AS idr, CASE WHEN i % 211 = 0 THEN 5 END AS lost,
  CASE WHEN i % 37 = 0 THEN 'missing' WHEN i % 41 = 0 THEN 'garbage' ELSE 'media' END AS what"""


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The master playlists, the corpus of playlists and segments, and that of an edge which lacks some and has others changed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = spark.sql(f"SELECT *, {_GIVEN} FROM {_EVENTS.replace('events)', '{events})')} e", events=events)
    seg = F.concat(F.lit(f"{_SITE}/"), F.col("u").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(".ts"))

    def make(batches):
        for b in batches:
            rows = b.to_pylist()
            bodies = [b"not media" if r["what"] == "garbage" else segment(r["start"], r["width"], r["height"], r["idr"], r["lost"]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bodies, pa.binary())], ["uri", "i", "body"])

    made = e.where("what <> 'missing'").select(seg.alias("uri"), "i", "start", "width", "height", "idr", "lost", "what")
    media = saved(spread(made).mapInArrow(make, "uri string, i long, body binary"))
    stamp = F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("n") * 2000 + F.when(F.col("i") % 83 == 0, 300).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    line = F.concat(F.when(F.col("i") % 29 == 0, "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXT-X-PROGRAM-DATE-TIME:"), stamp, F.lit("\n#EXTINF:"), F.when(F.col("i") % 71 == 0, "2.9").otherwise("2.0"), F.lit(",\n"), F.col("n").cast("string"), F.lit(".ts"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    lists = e.groupBy("u").agg(F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:1\n"), body, F.lit("\n#EXT-X-ENDLIST\n")).cast("binary").alias("body")).where("u % 45 <> 44")
    lists = lists.select(F.concat(F.lit(f"{_SITE}/"), F.col("u").cast("string"), F.lit("/index.m3u8")).alias("uri"), "body")
    answer = lambda bodies: bodies.select("uri", F.lit(200).alias("status"), "body", F.create_map(F.lit("X-Cache"), F.array(F.lit("HIT from edge"))).alias("headers"))
    corpus = answer(media.select("uri", "body").unionByName(saved(lists)))
    users = e.select("u").distinct()
    variant = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%dx%d,CODECS=\"avc1.64001f\",FRAME-RATE=5.000\n%d/index.m3u8", 9000 + F.col("u") % 6 * 10, 320 + F.col("u") % 6 * 16, 176 + F.col("u") % 6 * 16, "u")
    master = users.groupBy((F.col("u") % 2).cast("long").alias("manifest_id")).agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", variant.alias("v")))), lambda x: x["v"]), "\n")).alias("body"))
    edge = answer(media.where("i % 31 <> 0").withColumn("body", F.when(F.col("i") % 43 == 0, F.concat("body", F.lit("stale").cast("binary"))).otherwise(F.col("body"))))
    return master.withColumn("url", F.lit(f"{_SITE}/master.m3u8")), corpus, edge


_NUMBER = "CAST(u % 2 AS BIGINT) AS stream, u % 2 * 100000 + dense_rank() OVER (PARTITION BY u % 2 ORDER BY u) AS rendition"
RENDITIONS = f"""SELECT {_NUMBER}, 'video' AS kind, 0 AS period, CAST(9000 + u % 6 * 10 AS BIGINT) AS bandwidth, CAST(320 + u % 6 * 16 AS BIGINT) AS width, CAST(176 + u % 6 * 16 AS BIGINT) AS height, 'avc1.64001f' AS codecs, CAST(5000 AS BIGINT) AS fps_milli,
  CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS channels, CAST([] AS VARCHAR[]) AS captions, FALSE AS captions_none, CAST(NULL AS VARCHAR) AS audio_group, CAST(NULL AS VARCHAR) AS group_id, u % 45 = 44 AS failed, FALSE AS init_failed, CAST(NULL AS BIGINT) AS transfer, CAST(NULL AS VARCHAR) AS video_range,
  CAST(NULL AS VARCHAR) AS scheme, CAST([] AS VARCHAR[]) AS drm, FALSE AS live, CAST(2000000 AS BIGINT) AS target_us, CAST(NULL AS BIGINT) AS part_target_us, 'hls' AS format
FROM (SELECT DISTINCT user_id AS u FROM events) e"""

SEGMENTS = f"""SELECT stream, rendition, 'video' AS kind, 0 AS period, n AS sequence, what <> 'missing' AS fetched, what = 'media' AS parsed, TRUE AS supported, TRUE AS kept, FALSE AS truncated, FALSE AS opaque, CAST(CASE WHEN what = 'media' THEN 188 * (12 - (i % 211 = 0)::INT) ELSE 9 END AS BIGINT) AS bytes, CAST(CASE WHEN i % 71 = 0 THEN 2900000 ELSE 2000000 END AS BIGINT) AS declared_us,
  CAST(2000000 AS BIGINT) AS measured_us, CAST(start AS BIGINT) AS min_pts, CAST(90000 AS BIGINT) AS timescale, CAST(CASE WHEN i % 211 = 0 THEN 1 ELSE 0 END AS BIGINT) AS cc_errors, i % 29 = 0 AS discontinuity, sum((i % 29 = 0)::INT) OVER (PARTITION BY u ORDER BY n) AS discontinuity_sequence, CAST(NULL AS BIGINT) AS declared_start_us,
  1704067200000000 + n * 2000000 + CASE WHEN i % 83 = 0 THEN 300000 ELSE 0 END AS pdt_us, 'ts' AS container, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, 1 AS video_tracks, 0 AS audio_tracks, 'h264' AS codec, idr = 0 AND idr IS NOT NULL AS opens_keyframe, idr IS NOT NULL AS has_keyframe, CAST(18000 AS BIGINT) AS frame_dur, 10 - (i % 211 = 0)::INT AS pictures,
  77 AS profile_idc, 31 AS level_idc, CAST(NULL AS BIGINT) AS tier, CAST(NULL AS BIGINT) AS transfer, CAST(NULL AS BIGINT) AS object_type, CAST(NULL AS BOOLEAN) AS sbr, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS channels, FALSE AS key_declared, FALSE AS decrypted, FALSE AS decrypt_failed, FALSE AS encrypted, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS BOOLEAN) AS crypt_pattern,
  CAST(NULL AS BIGINT) AS clear_samples, CAST(NULL AS BIGINT) AS encrypted_samples, CAST([] AS VARCHAR[]) AS pssh, TRUE AS captions_scanned, CAST([] AS VARCHAR[]) AS captions_seen, FALSE AS mapped, FALSE AS ranged, FALSE AS accepts_ranges, 'cdn.example' AS host, CAST(i AS VARCHAR) AS digest, 'HIT' AS cache_status, FALSE AS uncacheable, n AS ordinal
FROM (SELECT *, {_NUMBER}, {_GIVEN} FROM {_EVENTS} e) g WHERE u % 45 <> 44"""

EDGES = f"""SELECT rendition, n AS sequence, 'near' AS edge, i % 31 = 0 AS missing, CASE WHEN i % 43 = 0 THEN 'stale' ELSE CAST(i AS VARCHAR) END AS digest
FROM (SELECT *, {_NUMBER} FROM {_EVENTS} e) g WHERE u % 45 <> 44"""

#: The first answered segment is asked for half of what it holds, or less.
PROBES = f"""SELECT 'cdn.example' AS host, 206 AS status, least(1024, arg_min(bytes, (rendition, sequence)) // 2) AS asked_bytes, least(1024, arg_min(bytes, (rendition, sequence)) // 2) AS got_bytes, FALSE AS failed FROM ({SEGMENTS}) WHERE fetched"""
