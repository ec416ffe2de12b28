"""Relations that the checks read, projected from the star-schema tables by one SQL text.

The text holds for Spark and for other engines; where dialects differ it has marks, which
``dialect`` replaces. All times are whole microseconds or ticks, so no result hangs on the order
in which doubles are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """
SELECT CAST(floor(u / 10) AS BIGINT) AS stream, u AS rendition,
  CASE WHEN u % 10 < 6 THEN 'video' WHEN u % 10 < 8 THEN 'audio' WHEN u % 10 = 8 THEN 'text' ELSE 'iframe' END AS kind,
  CAST(floor((n - 1) / 24) AS INT) AS period,
  n + CAST(floor(n / 20) AS BIGINT) AS sequence,
  i % 37 <> 0 AS fetched,
  i % 37 <> 0 AND i % 41 <> 0 AS parsed,
  i % 41 <> 0 OR u % 4 <> 1 AS supported,
  i % 53 = 0 AS truncated,
  n > u % 4 * 4 AS kept,
  u % 30 = 4 AS opaque,
  CAST(v + 20000 AS BIGINT) AS bytes,
  CAST(CASE WHEN i % 71 = 0 THEN 2900000 WHEN u % 13 = 0 THEN 2150000 ELSE 2000000 END AS BIGINT) AS declared_us,
  CAST(CASE WHEN i % 29 <> 0 THEN CASE WHEN u % 30 = 13 THEN 2500000 WHEN u % 21 = 4 AND n % 7 = 0 THEN 2600000 ELSE 2000000 END + (i % 5) * 1000 END AS BIGINT) AS measured_us,
  CAST((8589934592 - 1800000 + (n + CAST(floor(n / 20) AS BIGINT)) * 180000 + CASE WHEN i % 97 = 0 THEN 27000 WHEN i % 89 = 0 THEN -27000 ELSE i % 3 END + CASE WHEN u % 40 = 19 THEN 900000 ELSE 0 END) % 8589934592 AS BIGINT) AS min_pts,
  CAST(90000 AS BIGINT) AS timescale,
  CAST(CASE WHEN i % 211 = 0 THEN i % 4 ELSE 0 END AS BIGINT) AS cc_errors,
  t = 'error' AND i % 4 = 0 AS discontinuity,
  CAST(CAST(floor(n / 15) AS BIGINT) + CASE WHEN u % 50 = 3 THEN 1 ELSE 0 END AS BIGINT) AS discontinuity_sequence,
  CAST(CASE WHEN u % 3 = 0 THEN (n + CAST(floor(n / 20) AS BIGINT)) * 2000000 - 20000000 + CASE WHEN i % 61 = 0 THEN 400000 ELSE 0 END END AS BIGINT) AS declared_start_us,
  CAST(CASE WHEN u % 4 <> 1 THEN 1700000000000000 + (n + CAST(floor(n / 20) AS BIGINT)) * 2000000 + CASE WHEN i % 83 = 0 THEN 300000 WHEN i % 101 = 0 THEN -3000000 ELSE 0 END END AS BIGINT) AS pdt_us,
  CASE WHEN u % 20 = 7 AND i % 2 = 0 THEN 'mp4' ELSE 'ts' END AS container,
  CAST(CASE WHEN u % 10 < 6 THEN CASE WHEN i % 103 = 0 THEN 640 ELSE 320 + (u % 6) * 320 END END AS BIGINT) AS width,
  CAST(CASE WHEN u % 10 < 6 THEN CASE WHEN i % 103 = 0 THEN 360 ELSE 180 + (u % 6) * 180 END END AS BIGINT) AS height,
  CAST(CASE WHEN u % 10 < 6 AND i % 19 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS video_tracks,
  CAST(CASE WHEN u % 10 >= 6 AND u % 10 < 8 THEN 1 + CASE WHEN i % 59 = 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS audio_tracks,
  CASE WHEN u % 10 < 6 THEN CASE WHEN u % 7 = 2 THEN 'hevc' ELSE 'h264' END WHEN u % 10 < 8 THEN 'aac' END AS codec,
  CASE WHEN i % 11 <> 0 THEN i % 13 <> 0 END AS opens_keyframe,
  CASE WHEN i % 11 <> 0 THEN i % 113 <> 0 END AS has_keyframe,
  CAST(CASE WHEN u % 10 < 6 AND i % 17 <> 0 THEN CASE WHEN u % 12 = 5 THEN 3003 WHEN u % 15 = 1 THEN 3400 ELSE 3600 END + i % 2 END AS BIGINT) AS frame_dur,
  CAST(CASE WHEN u % 10 = 9 THEN 1 + CASE WHEN i % 23 = 0 THEN 1 ELSE 0 END WHEN u % 10 < 6 THEN 50 END AS BIGINT) AS pictures,
  CAST(CASE WHEN u % 10 BETWEEN 6 AND 7 THEN CASE WHEN i % 67 = 0 THEN 44100 ELSE 48000 END END AS BIGINT) AS sample_rate,
  CAST(CASE WHEN u % 10 BETWEEN 6 AND 7 THEN 2 END AS BIGINT) AS channels,
  CAST(CASE WHEN u % 10 BETWEEN 6 AND 7 AND u % 30 <> 6 THEN CASE WHEN u % 20 = 17 THEN 5 ELSE 2 END END AS BIGINT) AS object_type,
  CASE WHEN u % 10 BETWEEN 6 AND 7 THEN u % 20 = 17 OR u % 40 = 26 END AS sbr,
  CASE WHEN u % 10 BETWEEN 6 AND 7 THEN u % 60 = 17 END AS ps,
  u % 10 = 8 AND u % 20 = 8 AS mapped,
  u % 10 = 9 OR u % 35 = 3 AS ranged,
  i % 2 = 0 AS accepts_ranges,
  u % 10 < 6 AND i % 3 <> 0 AS captions_scanned,
  CASE WHEN i % 4 = 0 THEN {list}('CC1', 'CC2') WHEN i % 4 = 1 AND u % 5 = 1 THEN {list}('SERVICE1', 'CC1') WHEN i % 4 = 2 AND u % 20 = 12 THEN {list}('c708') ELSE {none} END AS captions_seen,
  u % 6 = 1 OR u % 6 = 2 AND n % 3 = 0 AS key_declared,
  u % 6 = 1 AND u % 4 <> 3 AS decrypted,
  u % 6 = 1 AND i % 149 = 0 AS decrypt_failed,
  u % 6 = 5 OR u % 12 = 2 AS encrypted,
  CASE WHEN u % 6 = 5 OR u % 12 = 2 THEN CASE WHEN u % 4 = 1 THEN 'cbcs' ELSE 'cenc' END END AS scheme,
  CASE WHEN u % 6 = 5 OR u % 12 = 2 THEN u % 8 = 1 END AS crypt_pattern,
  CAST(CASE WHEN u % 6 = 5 OR u % 12 = 2 THEN CASE WHEN n <= 1 + u % 3 THEN 50 ELSE 0 END END AS BIGINT) AS clear_samples,
  CAST(CASE WHEN u % 6 = 5 OR u % 12 = 2 THEN CASE WHEN n <= 1 + u % 3 OR u % 24 = 2 THEN 0 ELSE 50 END END AS BIGINT) AS encrypted_samples,
  CASE WHEN u % 6 = 5 THEN CASE WHEN u % 9 = 2 THEN {list}('playready') WHEN i % 2 = 0 THEN {list}('widevine', 'playready') ELSE {list}('widevine') END ELSE {none} END AS pssh,
  CASE WHEN u % 3 = 1 THEN 'MISS' WHEN i % 5 = 0 THEN 'HIT' WHEN i % 5 < 3 THEN 'MISS' END AS cache_status,
  i % 199 = 0 AS uncacheable,
  'host' || CAST(u % 9 AS {string}) AS host,
  CAST(i % 251 AS {string}) AS digest,
  CAST(CASE WHEN i % 2 = 0 THEN CASE WHEN u % 7 = 2 THEN 2 ELSE 100 END END AS BIGINT) AS profile_idc,
  CAST(CASE WHEN i % 2 = 0 THEN CASE WHEN u % 7 = 2 THEN CASE WHEN u % 5 = 1 THEN 120 ELSE 93 END ELSE 31 + CASE WHEN u % 14 = 0 THEN 9 ELSE 0 END END END AS BIGINT) AS level_idc,
  CAST(CASE WHEN u % 7 = 2 THEN CASE WHEN u % 4 = 2 THEN 1 ELSE 0 END END AS BIGINT) AS tier,
  CAST(CASE WHEN i % 5 <> 0 THEN CASE WHEN u % 16 = 0 THEN 16 ELSE 1 END END AS BIGINT) AS transfer,
  i AS ordinal
FROM (SELECT event_id AS i, user_id AS u, event_type AS t, CAST(round(value * 100) AS BIGINT) AS v,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e
"""

RENDITIONS = """
SELECT CAST(floor(u / 10) AS BIGINT) AS stream, u AS rendition,
  CASE WHEN u % 10 < 6 THEN 'video' WHEN u % 10 < 8 THEN 'audio' WHEN u % 10 = 8 THEN 'text' ELSE 'iframe' END AS kind,
  CAST(u % 2 AS INT) AS period,
  CAST(CASE WHEN u % 25 = 0 THEN 0 ELSE 90000 + (u % 6) * 12000 + CASE WHEN u % 11 = 0 THEN 300000 ELSE 0 END END AS BIGINT) AS bandwidth,
  CAST(CASE WHEN u % 10 < 6 OR u % 20 = 9 THEN 320 + (u % 6) * 320 END AS BIGINT) AS width,
  CAST(CASE WHEN u % 10 < 6 OR u % 20 = 9 THEN 180 + (u % 6) * 180 + CASE WHEN u % 17 = 3 THEN -180 ELSE 0 END END AS BIGINT) AS height,
  CASE WHEN u % 19 = 1 THEN '' WHEN u % 10 < 6 THEN CASE WHEN u % 14 = 2 THEN CASE WHEN u % 3 = 0 THEN 'hvc1.2.4.H93.B0' ELSE 'hev1.A2.4.L93.B0' END WHEN u % 23 = 5 THEN 'avc1.66.30' WHEN u % 29 = 4 THEN 'av01.0.08M.08' WHEN u % 31 = 3 THEN 'dvh1.05.01' ELSE 'avc1.64001f' END || ',mp4a.40.2' WHEN u % 10 < 8 THEN 'mp4a.40.' || CASE WHEN u % 4 = 2 THEN '5' ELSE '2' END ELSE 'wvtt' END AS codecs,
  CAST(CASE WHEN u % 10 < 6 AND u % 8 <> 0 THEN 25000 END AS BIGINT) AS fps_milli,
  CAST(CASE WHEN u % 10 BETWEEN 6 AND 7 THEN 48000 END AS BIGINT) AS sample_rate,
  CAST(CASE WHEN u % 10 BETWEEN 6 AND 7 THEN CASE WHEN u % 27 = 0 THEN 6 ELSE 2 END END AS BIGINT) AS channels,
  CASE WHEN u % 10 < 6 AND u % 5 = 0 THEN {list}('CC3', 'CC2') WHEN u % 10 < 6 AND u % 5 = 1 THEN {list}('SERVICE1', 'CC4') WHEN u % 10 < 6 AND u % 5 = 2 THEN {list}('CC1', 'SERVICE2', 'AD1') ELSE {none} END AS captions,
  u % 10 < 6 AND u % 5 = 3 AS captions_none,
  CASE WHEN u % 10 < 6 AND u % 4 = 0 THEN 'aud' || CAST(u % 3 AS {string}) END AS audio_group,
  CASE WHEN u % 10 BETWEEN 6 AND 7 THEN 'aud' || CAST(u % 2 AS {string}) END AS group_id,
  u % 45 = 44 AS failed,
  u % 31 = 30 AS init_failed,
  CAST(CASE WHEN u % 16 < 2 THEN 16 WHEN u % 16 < 8 THEN 1 END AS BIGINT) AS transfer,
  CASE WHEN u % 16 < 2 THEN 'PQ' WHEN u % 16 = 3 THEN 'HLG' ELSE 'SDR' END AS video_range,
  CASE WHEN u % 6 = 5 THEN 'cenc' END AS scheme,
  CASE WHEN u % 6 = 5 THEN CASE WHEN u % 9 = 5 THEN {list}('fairplay', 'widevine') ELSE {list}('widevine', 'playready') END ELSE {none} END AS drm,
  u % 2 = 0 AS live,
  CAST(2000000 AS BIGINT) AS target_us,
  CAST(CASE WHEN u % 4 = 0 THEN 550000 ELSE 500000 END AS BIGINT) AS part_target_us,
  CASE WHEN floor(u / 10) % 2 = 0 THEN 'dash' ELSE 'hls' END AS format
FROM (SELECT DISTINCT user_id AS u FROM events) e
"""

PARTS = """
SELECT u AS rendition, CAST(floor((n - 1) / 4) AS BIGINT) AS sequence, CAST((n - 1) % 4 AS BIGINT) AS idx,
  CAST(CASE WHEN i % 109 = 0 THEN 640000 ELSE 500000 END AS BIGINT) AS declared_us,
  CAST((8589934592 - 1800000 + (n - 1) * 45000 + CASE WHEN i % 73 = 0 THEN 18000 ELSE 0 END) % 8589934592 AS BIGINT) AS min_pts,
  CAST(90000 AS BIGINT) AS timescale,
  i % 47 <> 0 AS parsed,
  (n - 1) % 4 = 0 AS independent,
  i % 43 <> 0 AS opens_keyframe
FROM (SELECT event_id AS i, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id % 2 = 0) e
"""

SPLICES = """
SELECT event_id AS splice, user_id AS rendition, CAST(event_id % 100000 AS BIGINT) AS event,
  CAST(CASE WHEN event_id % 17 <> 0 THEN (8589934592 - 1800000 + n * 180000 * 4 + CASE WHEN event_id % 5 = 0 THEN 60000 ELSE event_id % 1000 END) % 8589934592 END AS BIGINT) AS pts
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup' AND user_id % 10 < 6) e
"""

#: Breaks that the manifest declares: by media time in ticks or else in microseconds, else by sequence, else by wall clock; some carry a section with a clock of its own.
BREAKS = """
SELECT event_id AS break, user_id AS rendition, CAST(event_id % 100000 AS BIGINT) AS event,
  CAST(CASE WHEN event_id % 3 = 0 THEN (8589934592 - 1800000 + n * 720000) % 8589934592 + CASE WHEN event_id % 15 = 0 THEN 45000 ELSE 0 END END AS BIGINT) AS media_pts,
  CAST(CASE WHEN event_id % 9 = 2 THEN floor(((8589934592 - 1800000 + n * 720000) % 8589934592 + CASE WHEN event_id % 2 = 0 THEN 45000 ELSE 0 END) / 9) * 100 END AS BIGINT) AS media_us,
  CAST(CASE WHEN event_id % 3 = 1 THEN n * 4 END AS BIGINT) AS at_sequence,
  CAST(CASE WHEN event_id % 4 <> 0 THEN 1700000000000000 + n * 8000000 + CASE WHEN event_id % 7 = 0 THEN 700000 ELSE 0 END END AS BIGINT) AS clock_us,
  CAST(CASE WHEN event_id % 6 = 0 THEN (8589934592 - 1800000 + n * 720000 + CASE WHEN event_id % 5 = 0 THEN 60000 ELSE event_id % 1000 END + CASE WHEN event_id % 12 = 0 THEN 90000 ELSE 0 END) % 8589934592 END AS BIGINT) AS section_pts
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup' AND user_id % 10 < 6) e
"""

#: Cues of text segments, as times on the media clock: a cue or two a segment, none in some.
CUES = f"""
SELECT rendition, sequence, CAST(origin_us + start_us + d AS BIGINT) AS begin_us, CAST(origin_us + start_us + d + 500000 AS BIGINT) AS end_us
FROM (SELECT stream, rendition, sequence, ordinal, parsed, k, coalesce(sum(declared_us) OVER (PARTITION BY rendition, k ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_us, (ordinal % 7 - 1) * CASE WHEN rendition % 20 = 8 THEN 400000 ELSE 100000 END + k * 100000 AS d
  FROM ({SEGMENTS}) x CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k WHERE kind = 'text') y
JOIN (SELECT stream, min(CAST(floor(min_pts / 9) AS BIGINT) * 100) AS origin_us FROM ({SEGMENTS}) z WHERE parsed AND kind = 'video' GROUP BY stream) o ON o.stream = y.stream
WHERE parsed AND rendition % 50 <> 18 AND (k = 0 OR ordinal % 3 = 0)
"""

#: One request for the first bytes of a host: what it answered.
PROBES = """
SELECT 'host' || CAST(h AS {string}) AS host, CAST(CASE WHEN h % 5 = 4 THEN NULL WHEN h % 3 = 0 THEN 206 ELSE 200 END AS BIGINT) AS status,
  CAST(1024 AS BIGINT) AS asked_bytes, CAST(CASE WHEN h % 3 = 0 AND h <> 6 THEN 1024 ELSE 40000 END AS BIGINT) AS got_bytes, h % 5 = 4 AS failed
FROM (SELECT DISTINCT user_id % 9 AS h FROM events) e
"""

#: Polls of live playlists as the lists they showed: some stand still, go back, jump out of the window, are empty, fail or state no interval.
OBSERVATIONS = """
SELECT rendition, poll, observed_us, CASE WHEN rendition % 29 = 3 THEN {none} ELSE {each}(newest - 5, newest), {x} 's' || CAST(x AS {string})) END AS uris,
  CASE WHEN rendition % 29 = 3 THEN {no_longs} ELSE {each}(newest - 5, newest), {x} CAST(1900000 + x % 3 * 100000 AS BIGINT)) END AS durations_us,
  CAST(CASE WHEN rendition % 31 <> 4 THEN 2000000 END AS BIGINT) AS target_us, failed
FROM (SELECT u AS rendition, n AS poll, CAST(n * 2000000 AS BIGINT) AS observed_us,
  CAST(100 + CASE WHEN u % 23 = 0 THEN 7 WHEN u % 9 = 4 AND n BETWEEN 20 AND 28 THEN 20 WHEN u % 14 = 3 AND n = 30 THEN 25 WHEN u % 13 = 6 THEN n * 9 WHEN u % 11 = 7 THEN floor(n / 2) ELSE n + CASE WHEN u % 8 = 5 THEN n ELSE 0 END END AS BIGINT) AS newest, i % 397 = 0 OR u % 37 = 36 AS failed
FROM (SELECT event_id AS i, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e) o
"""

#: What other edges answered to the same requests; the third is out of reach.
EDGES = """
SELECT u AS rendition, n + CAST(floor(n / 20) AS BIGINT) AS sequence, 'edge' || CAST(k AS {string}) AS edge, k = 2 OR k = 1 AND i % 163 = 0 AS missing,
  CAST(CASE WHEN k = 1 AND i % 107 = 0 THEN (i + 1) % 251 ELSE i % 251 END AS {string}) AS digest
FROM (SELECT event_id AS i, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) k WHERE k <= CAST(floor(u / 10) AS BIGINT) % 4
"""

#: What the time sources of a stream said, and whether the segment after the newest of one of its renditions is there already.
CLOCKS = """
SELECT DISTINCT CAST(floor(u / 10) AS BIGINT) AS stream, CAST(floor(u / 20) AS BIGINT) % 5 AS sources, floor(u / 20) % 5 <> 3 AS spoken, CAST(NULL AS BIGINT) AS now_us,
  CAST(CASE WHEN floor(u / 20) % 5 = 1 THEN 1500000 WHEN floor(u / 20) % 5 = 2 THEN -200000 END AS BIGINT) AS skew_us
FROM (SELECT DISTINCT user_id AS u FROM events) e WHERE floor(u / 20) % 5 > 0
"""
AHEAD = """
SELECT u AS rendition, u % 3 = 0 AS served FROM (SELECT DISTINCT user_id AS u FROM events) e WHERE u % 10 = 0
"""

SPARK = {"string": "STRING", "list": "array", "none": "CAST(array() AS ARRAY<STRING>)", "each": "transform(sequence", "x": "x ->", "no_longs": "CAST(array() AS ARRAY<BIGINT>)"}
DUCKDB = {"string": "VARCHAR", "list": "list_value", "none": "CAST([] AS VARCHAR[])", "each": "list_transform(generate_series", "x": "lambda x:", "no_longs": "CAST([] AS BIGINT[])"}


def dialect(sql: str, words: dict[str, str]) -> str:
    return sql.format(**words)


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(dialect(sql.replace("FROM events", "FROM {{events}}"), SPARK), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def oracle(body: str) -> str:
    """A query over ``s`` (segments), ``p`` (the parsed ones), ``r`` (renditions), all of usable renditions, and the other relations."""
    others = ", ".join(f"{name} AS ({dialect(sql, DUCKDB)})" for name, sql in OTHERS.items())
    return f"""WITH s0 AS ({dialect(SEGMENTS, DUCKDB)}), r0 AS ({dialect(RENDITIONS, DUCKDB)}),
r AS (SELECT * FROM r0 WHERE NOT failed), s AS (SELECT s0.* FROM s0 JOIN r USING (rendition)),
p AS (SELECT s.* FROM s WHERE parsed),
{others}
{body}"""


OTHERS = {"parts": PARTS, "splices": SPLICES, "breaks": BREAKS, "cues": CUES, "probes": PROBES, "observations": OBSERVATIONS, "edges": EDGES, "clocks": CLOCKS, "ahead": AHEAD}


def on(sql: str, segments: str, renditions: str, **others: str) -> str:
    """A check's SQL over other relations than the projected ones; those not given are empty."""
    given = {"s0": (SEGMENTS, segments), "r0": (RENDITIONS, renditions)} | {name: (projected, others.get(name, f"SELECT * FROM ({dialect(projected, DUCKDB)}) WHERE FALSE")) for name, projected in OTHERS.items()}
    for name, (projected, other) in given.items():
        sql = sql.replace(f"{name} AS ({dialect(projected, DUCKDB)})", f"{name} AS ({other})")
    return sql
