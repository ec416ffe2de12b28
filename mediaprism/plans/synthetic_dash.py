"""DASH presentations made from the ``events`` table as fragments of bytes, and what is to be found in them as SQL.

Ten users are one presentation: six video representations (four by template, one behind an index, one behind an index of indexes) and a
text one. Each event is a fragment: ten pictures behind their lengths, captions in the first, or a cue and a silence.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.plans.synthetic import PICTURES, STEP
from mediaprism.storage import saved, spread

_SITE = "https://cdn.example/vod"
_ENTRIES = 8
#: A splice section: event 7 at tick 900,000, for which no media here has a splice.
_SECTION = "/DAgAAAAAAAAAP/wDwUAAAAHf0/+AA27oAABAAAAAAAAAAAA"
_EVENTS = "(SELECT user_id AS u, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
#: What each fragment is given, for both engines.
_GIVEN = """CAST((n - 1) * 180000 + CASE WHEN i % 97 = 0 THEN 27000 ELSE 0 END AS BIGINT) AS start, CASE WHEN i % 113 = 0 THEN NULL WHEN i % 13 = 0 THEN 4 ELSE 0 END AS idr, i % 3 = 0 AS field, i % 5 = 0 AND u % 4 <> 3 AS service,
  CASE WHEN u % 10 = 8 THEN 'text' WHEN u % 10 = 4 THEN 'index' WHEN u % 10 = 5 THEN 'indexes' ELSE 'template' END AS how,
  CASE WHEN i % 37 = 0 AND u % 10 NOT IN (4, 5) THEN 'missing' WHEN i % 41 = 0 THEN 'garbage' ELSE 'media' END AS what"""
_WANTED = "(u % 10 < 6 OR u % 10 = 8)"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def init(kind: str, width: int, height: int) -> bytes:
    if kind == "text":
        entry = _box(b"wvtt", bytes(8), _box(b"vttC", b"WEBVTT"))
    else:
        entry = _box(b"avc1", bytes(24), struct.pack(">HH", width, height), bytes(50), _box(b"avcC", bytes([1, 77, 0, 31, 0xFF, 0xE0])))
    tkhd, mdhd = _box(b"tkhd", bytes(12), struct.pack(">I", 1), bytes(68)), _box(b"mdhd", bytes(12), struct.pack(">I", 90_000), bytes(8))
    trak = _box(b"trak", tkhd, _box(b"mdia", mdhd, _box(b"minf", _box(b"stbl", _box(b"stsd", bytes(4), struct.pack(">I", 1), entry)))))
    return _box(b"ftyp", b"iso6", bytes(4)) + _box(b"moov", trak, _box(b"mvex", _box(b"trex", bytes(4), struct.pack(">5I", 1, 1, STEP, 0, 0x10000))))


def _unit(body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + body


def _captions(field: bool, service: bool) -> bytes:
    """A message of caption data: a pair of the first field, and a packet of the first service."""
    triples = (b"\xfc\x41\x42" if field else b"") + (b"\xff\x02\x21\xfe\x41\x00" if service else b"")
    body = b"\xb5\x00\x31GA94\x03" + bytes([0x40 | len(triples) // 3, 0xFF]) + triples + b"\xff"
    return _unit(b"\x06\x04" + bytes([len(body)]) + body + b"\x80") if triples else b""


def fragment(kind: str, start: int, idr: int | None, field: bool, service: bool) -> bytes:
    if kind == "text":
        bodies, step = [_box(b"vttc", _box(b"payl", b"said")), _box(b"vtte")], 5 * STEP
    else:
        bodies, step = [(_captions(field, service) if k == 0 else b"") + _unit((b"\x65" if k == idr else b"\x41") + b"\x88" * 40) for k in range(PICTURES)], STEP
    flags = [0x2000000 if kind == "text" or k == idr else 0x1010000 for k in range(len(bodies))]
    run = b"".join(struct.pack(">III", step, len(b), f) for b, f in zip(bodies, flags, strict=True))

    def moof(offset: int) -> bytes:
        return _box(b"moof", _box(b"traf", _box(b"tfhd", struct.pack(">II", 0x20000, 1)), _box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", start)), _box(b"trun", struct.pack(">IIi", 0x701, len(bodies), offset), run)))

    return moof(len(moof(0)) + 8) + _box(b"mdat", *bodies)


def _index(entries: list[tuple[int, bool]], segments: list[int]) -> bytes:
    rows = b"".join(struct.pack(">III", size | nested << 31, n * 180_000, 0) for (size, nested), n in zip(entries, segments, strict=True))
    return _box(b"sidx", bytes(4), struct.pack(">IIIIHH", 1, 90_000, 0, 0, 0, len(entries)), rows)


def single_file(bodies: list[bytes], nested: bool, width: int, height: int) -> tuple[bytes, int, int]:
    """One file of an init, its index and fragments; where the index lies and how long it is."""
    head = init("video", width, height)
    if nested:
        groups = [bodies[i : i + _ENTRIES] for i in range(0, len(bodies), _ENTRIES)]
        inner = [_index([(len(b), False) for b in g], [1] * len(g)) + b"".join(g) for g in groups]
        index = _index([(len(x), True) for x in inner], [len(g) for g in groups])
        return head + index + b"".join(inner), len(head), len(index)
    index = _index([(len(b), False) for b in bodies], [1] * len(bodies))
    return head + index + b"".join(bodies), len(head), len(index)


def presentations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The manifests and the corpus."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = spark.sql(f"SELECT *, {_GIVEN} FROM {_EVENTS.replace('events)', '{events})')} e WHERE {_WANTED}", events=events)
    e = e.withColumns({"width": 320 + F.col("u") % 6 * 16, "height": 176 + F.col("u") % 6 * 16})
    columns = ["u", "n", "how", "start", "idr", "field", "service", "what", "width", "height"]

    def body(r: dict) -> bytes:
        return b"not media" if r["what"] == "garbage" else fragment("text" if r["how"] == "text" else "video", r["start"], r["idr"], r["field"], r["service"])

    def pieces(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{_SITE}/{r['u']}/{r['n']}.m4s" for r in rows]), pa.array([body(r) for r in rows], pa.binary())], ["uri", "body"])

    def inits(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{_SITE}/{r['u']}/init.mp4" for r in rows]), pa.array([init("text" if r["how"] == "text" else "video", r["width"], r["height"]) for r in rows], pa.binary())], ["uri", "body"])

    def files(key, frame):
        rows = sorted(frame.to_dict("records"), key=lambda r: r["n"])
        for r in rows:
            r["idr"] = None if r["idr"] != r["idr"] else r["idr"]
        whole, at, size = single_file([body(r) for r in rows], rows[0]["how"] == "indexes", rows[0]["width"], rows[0]["height"])
        import pandas as pd

        return pd.DataFrame([(key[0], f"{_SITE}/{key[0]}/all.mp4", whole, at, size)], columns=["u", "uri", "body", "at", "size"])

    chosen = e.select(*columns)
    apart = saved(spread(chosen.where("how NOT IN ('index', 'indexes') AND what <> 'missing'")).mapInArrow(pieces, "uri string, body binary"))
    heads = saved(chosen.where("how NOT IN ('index', 'indexes')").select("u", "how", "width", "height").distinct().mapInArrow(inits, "uri string, body binary"))
    singles = saved(chosen.where("how IN ('index', 'indexes')").groupBy("u").applyInPandas(files, "u long, uri string, body binary, at long, size long"))
    corpus = apart.unionByName(heads).unionByName(singles.select("uri", "body")).withColumn("status", F.lit(200))
    reps = e.groupBy("u", "how", "width", "height").agg(F.count("*").alias("n")).join(singles.select("u", "at", "size"), "u", "left")
    timed = F.format_string('<SegmentTemplate timescale="90000" media="%d/$Number$.m4s" initialization="%d/init.mp4" startNumber="1"><SegmentTimeline><S t="0" d="180000" r="%d"/></SegmentTimeline></SegmentTemplate>', "u", "u", F.col("n") - 1)
    indexed = F.format_string('<BaseURL>%d/all.mp4</BaseURL><SegmentBase indexRange="%d-%d"><Initialization range="0-%d"/></SegmentBase>', "u", "at", F.col("at") + F.col("size") - 1, F.col("at") - 1)
    inner = F.when(F.col("how") == "index", indexed).when(F.col("how") == "indexes", F.format_string('<BaseURL>%d/all.mp4</BaseURL><SegmentBase><Initialization range="0-%d"/></SegmentBase>', "u", F.col("at") - 1)).otherwise(timed)
    video = F.format_string('<Representation id="%d" bandwidth="%d" width="%d" height="%d" codecs="avc1.64001f" frameRate="5">%s</Representation>', "u", 9000 + F.col("u") % 6 * 10, "width", "height", inner)
    words = F.format_string('<Representation id="%d" bandwidth="500" codecs="wvtt">%s</Representation>', "u", inner)
    heard = '<Accessibility schemeIdUri="urn:scte:dash:cc:cea-608:2015" value="CC1=eng"/><Accessibility schemeIdUri="urn:scte:dash:cc:cea-708:2015" value="1=lang:eng"/>'
    of = lambda text: F.array_join(F.array_sort(F.collect_list(F.when((F.col("how") == "text") == F.lit(text), F.col("r")))), "")
    sets = reps.withColumn("r", F.when(F.col("how") == "text", words).otherwise(video)).groupBy(F.floor(F.col("u") / 10).alias("manifest_id")).agg(of(False).alias("video"), of(True).alias("text"))
    # Events at the fragments of one representation: half of them off a segment's start, a third with a section, and one of another scheme.
    event = F.format_string('<Event presentationTime="%d" id="%d">%s</Event>', (F.col("n") - 1) * 2000 + F.when(F.col("i") % 2 == 0, 500).otherwise(0), "i", F.when(F.col("i") % 3 == 0, f"<scte35:Signal><scte35:Binary>{_SECTION}</scte35:Binary></scte35:Signal>").otherwise(""))
    told = e.where("u % 10 = 0 AND i % 11 = 0").groupBy(F.floor(F.col("u") / 10).alias("manifest_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", event.alias("x")))), lambda x: x["x"]), "").alias("x"))
    told = told.select("manifest_id", F.concat(F.lit('<EventStream schemeIdUri="urn:scte:scte35:2014:xml+bin" timescale="1000">'), "x", F.lit('</EventStream><EventStream schemeIdUri="urn:other"><Event presentationTime="1"/></EventStream>')).alias("told"))
    sets = sets.join(told, "manifest_id", "left").na.fill("", ["told"])
    body_ = F.concat(F.lit('<MPD type="static" mediaPresentationDuration="PT9999S"><Period>'), "told", F.when(F.col("video") != "", F.concat(F.lit(f'<AdaptationSet contentType="video" mimeType="video/mp4">{heard}'), "video", F.lit("</AdaptationSet>"))).otherwise(""), F.when(F.col("text") != "", F.concat(F.lit('<AdaptationSet contentType="text" mimeType="application/mp4">'), "text", F.lit("</AdaptationSet>"))).otherwise(""), F.lit("</Period></MPD>"))
    return saved(sets.select("manifest_id", F.lit(f"{_SITE}/manifest.mpd").alias("url"), body_.alias("body"))), corpus


_NUMBER = "CAST(floor(u / 10) AS BIGINT) AS stream, CAST(floor(u / 10) AS BIGINT) * 100000 + dense_rank() OVER (PARTITION BY floor(u / 10) ORDER BY CAST(u AS VARCHAR)) AS rendition"
_VIDEO = "u % 10 <> 8"
_BARE, _CAPTION = len(fragment("video", 0, 0, False, False)), {(f, s): len(_captions(f, s)) for f in (False, True) for s in (False, True)}
RENDITIONS = f"""SELECT {_NUMBER}, CASE WHEN {_VIDEO} THEN 'video' ELSE 'text' END AS kind, 0 AS period, CAST(CASE WHEN {_VIDEO} THEN 9000 + u % 6 * 10 ELSE 500 END AS BIGINT) AS bandwidth, CAST(CASE WHEN {_VIDEO} THEN 320 + u % 6 * 16 END AS BIGINT) AS width, CAST(CASE WHEN {_VIDEO} THEN 176 + u % 6 * 16 END AS BIGINT) AS height, CASE WHEN {_VIDEO} THEN 'avc1.64001f' ELSE 'wvtt' END AS codecs, CAST(CASE WHEN {_VIDEO} THEN 5000 END AS BIGINT) AS fps_milli,
  CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS channels, CASE WHEN {_VIDEO} THEN ['CC1', 'SERVICE1'] ELSE CAST([] AS VARCHAR[]) END AS captions, FALSE AS captions_none, CAST(NULL AS VARCHAR) AS audio_group, CAST(NULL AS VARCHAR) AS group_id, FALSE AS failed, FALSE AS init_failed, CAST(NULL AS BIGINT) AS transfer, CAST(NULL AS VARCHAR) AS video_range,
  CAST(NULL AS VARCHAR) AS scheme, CAST([] AS VARCHAR[]) AS drm, FALSE AS live, CAST(NULL AS BIGINT) AS target_us, CAST(NULL AS BIGINT) AS part_target_us, 'dash' AS format
FROM (SELECT DISTINCT user_id AS u FROM events) e WHERE {_WANTED}"""
SEGMENTS = f"""SELECT stream, rendition, CASE WHEN {_VIDEO} THEN 'video' ELSE 'text' END AS kind, 0 AS period, n AS sequence, what <> 'missing' AS fetched, what = 'media' AS parsed, TRUE AS supported, TRUE AS kept, FALSE AS truncated, FALSE AS opaque,
  CAST(CASE WHEN what = 'garbage' THEN 9 WHEN NOT {_VIDEO} THEN {len(fragment("text", 0, None, False, False))} ELSE {_BARE} + CASE WHEN field AND service THEN {_CAPTION[True, True]} WHEN field THEN {_CAPTION[True, False]} WHEN service THEN {_CAPTION[False, True]} ELSE 0 END END AS BIGINT) AS bytes, CAST(2000000 AS BIGINT) AS declared_us,
  CAST(2000000 AS BIGINT) AS measured_us, start AS min_pts, CAST(90000 AS BIGINT) AS timescale, 0 AS cc_errors, FALSE AS discontinuity, 0 AS discontinuity_sequence, CAST((n - 1) * 2000000 AS BIGINT) AS declared_start_us, CAST(NULL AS BIGINT) AS pdt_us, 'mp4' AS container, CAST(CASE WHEN {_VIDEO} THEN 320 + u % 6 * 16 END AS BIGINT) AS width, CAST(CASE WHEN {_VIDEO} THEN 176 + u % 6 * 16 END AS BIGINT) AS height,
  ({_VIDEO})::INT AS video_tracks, 0 AS audio_tracks, CASE WHEN {_VIDEO} THEN 'h264' ELSE 'wvtt' END AS codec, CASE WHEN {_VIDEO} THEN idr = 0 AND idr IS NOT NULL END AS opens_keyframe, CASE WHEN {_VIDEO} THEN idr IS NOT NULL END AS has_keyframe, CAST(CASE WHEN {_VIDEO} THEN 18000 END AS BIGINT) AS frame_dur, CASE WHEN {_VIDEO} THEN 10 END AS pictures,
  CASE WHEN {_VIDEO} THEN 77 END AS profile_idc, CASE WHEN {_VIDEO} THEN 31 END AS level_idc, CAST(NULL AS BIGINT) AS tier, CAST(NULL AS BIGINT) AS transfer, CAST(NULL AS BIGINT) AS object_type, CAST(NULL AS BOOLEAN) AS sbr, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS channels, FALSE AS key_declared, FALSE AS decrypted, FALSE AS decrypt_failed, FALSE AS encrypted, CAST(NULL AS VARCHAR) AS scheme, CAST(NULL AS BOOLEAN) AS crypt_pattern,
  CAST(NULL AS BIGINT) AS clear_samples, CAST(NULL AS BIGINT) AS encrypted_samples, CAST([] AS VARCHAR[]) AS pssh, {_VIDEO} AS captions_scanned, CASE WHEN {_VIDEO} AND field AND service THEN ['CC1', 'SERVICE1'] WHEN {_VIDEO} AND field THEN ['CC1'] WHEN {_VIDEO} AND service THEN ['SERVICE1'] ELSE CAST([] AS VARCHAR[]) END AS captions_seen, TRUE AS mapped, how IN ('index', 'indexes') AS ranged, FALSE AS accepts_ranges, 'cdn.example' AS host, CAST(i AS VARCHAR) AS digest, CAST(NULL AS VARCHAR) AS cache_status, FALSE AS uncacheable, n AS ordinal
FROM (SELECT *, {_NUMBER}, {_GIVEN} FROM {_EVENTS} e WHERE {_WANTED}) g"""
BREAKS = f"""SELECT b.n AS break, rendition, CAST(NULL AS BIGINT) AS event, CAST(NULL AS BIGINT) AS media_pts, begins AS media_us, CAST(NULL AS BIGINT) AS at_sequence, CAST(NULL AS BIGINT) AS clock_us, CAST(NULL AS BIGINT) AS section_pts
FROM (SELECT CAST(floor(u / 10) AS BIGINT) AS stream, row_number() OVER (PARTITION BY floor(u / 10) ORDER BY n) AS n, CAST((n - 1) * 2000000 + CASE WHEN i % 2 = 0 THEN 500000 ELSE 0 END AS BIGINT) AS begins FROM {_EVENTS} e WHERE u % 10 = 0 AND i % 11 = 0) b JOIN ({RENDITIONS}) v ON v.stream = b.stream AND v.kind = 'video'"""
CUES = f"""SELECT rendition, n AS sequence, CAST(round(start / 90.0) * 1000 AS BIGINT) AS begin_us, CAST(round((start + 90000) / 90.0) * 1000 AS BIGINT) AS end_us FROM (SELECT *, {_NUMBER}, {_GIVEN} FROM {_EVENTS} e WHERE {_WANTED}) g WHERE how = 'text' AND what = 'media'"""
PROBES = f"""SELECT 'cdn.example' AS host, 206 AS status, arg_min(bytes, (rendition, sequence)) AS asked_bytes, arg_min(bytes, (rendition, sequence)) AS got_bytes, FALSE AS failed FROM ({SEGMENTS}) WHERE fetched AND ranged HAVING count(*) > 0"""
