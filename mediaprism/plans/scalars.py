"""Scalar functions over texts made from the ``events`` table, with what they must give as plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.functions import codecs, text


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event: each function of texts that hold the event's number."""
    i = F.col("event_id")
    s = i.cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    two = F.lpad((i % 60).cast("string"), 2, "0")
    listed = text.attributes(c("A=", s, ',b="x,', s, '",A=', (i + 1).cast("string")))
    key = F.to_binary(F.lpad(F.hex(i), 32, "0"), F.lit("hex"))
    sealed = F.aes_encrypt(c("text ", s).cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), text.sequence_iv(i))
    words = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), s), F.lit(1), (i % 5).cast("int"))
    us = lambda x: F.unix_micros(x).cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        i.alias("i"),
        listed["A"].alias("attribute"),
        listed["B"].alias("quoted"),
        text.iso_duration(c("P", (i % 3).cast("string"), "DT", (i % 24).cast("string"), "H", (i % 60).cast("string"), "M", (i % 60).cast("string"), ".5S")).alias("iso"),
        text.resolution(c(s, "x", (i % 7).cast("string")))["width"].cast("long").alias("width"),
        us(text.program_date_time(c("2024-01-01T00:00:", two, ".250+02:00"))).alias("pdt"),
        us(text.http_date(c("Mon, 01 Jan 2024 00:00:", two, " GMT"))).alias("http"),
        us(text.lenient_utc(c("2024-01-01T00:00:", two))).alias("lenient"),
        text.human_bytes(i * 1024 * 512).alias("bytes"),
        text.human_bitrate((i * 250_000).cast("double")).alias("bitrate"),
        text.human_fps(F.lit(25.0) + (i % 4) / 4).alias("fps"),
        text.human_sample_rate(F.lit(22050.0) * (1 + i % 2)).alias("rate"),
        text.human_channels(i % 9 + 1).alias("channels"),
        text.signed_ms((i % 7 - 3) * 5000).alias("ms"),
        text.plural(i % 3, "segment").alias("plural"),
        text.joined_and(words).alias("joined"),
        text.counts_text(F.transform(F.sequence(F.lit(0).cast("long"), i % 4), lambda k: F.when(k % 2 == 0, "x").otherwise("y"))).alias("counts"),
        text.short_target(c("https://h/a/b", s, "/c.ts?x=1/2")).alias("short"),
        text.host(c("https://h", s, ".example:8443/a")).alias("host"),
        text.extension(c("https://h/a/b.", (i % 3).cast("string"), "TS?x=.mpd")).alias("extension"),
        text.resolved(c("https://h/a/", s, "/b.m3u8"), F.lit("../c.ts?d")).alias("resolved"),
        F.hex(text.hex_iv(c("0x", F.lpad(F.hex(i), 32, "0")))).alias("iv"),
        F.hex(text.hex_section(c("0X", F.lpad(F.hex(i), 8, "0")))).alias("section"),
        F.hex(text.sequence_iv(i)).alias("sequence_iv"),
        text.decrypted(F.substr(sealed, F.lit(17), F.octet_length(sealed)), key, text.sequence_iv(i)).cast("string").alias("opened"),
        text.digest(c("body ", s).cast("binary")).alias("digest"),
        text.drm_system(F.when(i % 4 == 0, "com.widevine").when(i % 4 == 1, c("URN:UUID:AB-", s)).when(i % 4 == 2, "identity")).alias("system"),
        text.header(F.create_map(F.lit("Age"), F.array(F.lit("1")), F.lit("X-Cache"), F.array(c("HIT ", s))), "x-cache-status", "x-cache").alias("header"),
        codecs.declared_family(F.when(i % 2 == 0, "mp4a.40.2, hvc1.2.4.L93.B0").otherwise("ec-3,avc3.4d001f"), F.lit("video")).alias("family"),
        codecs.avc_level(c("avc1.6400", F.lpad(F.hex(i % 52), 2, "0"))).cast("double").alias("level"),
        codecs.aac_object_type(c("mp4a.40.", (i % 30).cast("string"))).cast("long").alias("object_type"),
        codecs.range_of_transfer(i % 20).alias("range"),
    )


SQL: dict[str, str] = {
    "functions": """SELECT i, CAST(i + 1 AS VARCHAR) AS attribute, 'x,' || i AS quoted, (i % 3) * 86400 + (i % 24) * 3600 + (i % 60) * 61 + CAST(0.5 AS DOUBLE) AS iso, i AS width,
  CAST(1704067200000000 - 7200000000 + (i % 60) * 1000000 + 250000 AS DOUBLE) AS pdt, CAST(1704067200000000 + (i % 60) * 1000000 AS DOUBLE) AS http, CAST(1704067200000000 + (i % 60) * 1000000 AS DOUBLE) AS lenient,
  CASE WHEN i = 0 THEN '0 B' WHEN i = 1 THEN '512.0 KiB' WHEN i < 2048 THEN i // 2 || CASE WHEN i % 2 = 1 THEN '.5 MiB' ELSE '.0 MiB' END WHEN i < 2097152 THEN printf('%.1f GiB', floor(i / CAST(204.8 AS DOUBLE) + 0.5) / 10) ELSE printf('%.1f TiB', floor(i / CAST(209715.2 AS DOUBLE) + 0.5) / 10) END AS bytes,
  CASE WHEN i = 0 THEN '0 bps' WHEN i < 4 THEN i * 250 || ' kbps' ELSE i // 4 || CASE i % 4 WHEN 0 THEN '.00' WHEN 1 THEN '.25' WHEN 2 THEN '.50' ELSE '.75' END || ' Mbps' END AS bitrate,
  CASE i % 4 WHEN 0 THEN '25' WHEN 1 THEN '25.25' WHEN 2 THEN '25.5' ELSE '25.75' END || ' fps' AS fps, CASE WHEN i % 2 = 0 THEN '22.05 kHz' ELSE '44.1 kHz' END AS rate,
  CASE i % 9 + 1 WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE i % 9 + 1 || ' ch' END AS channels, CASE WHEN i % 7 >= 3 THEN '+' ELSE '' END || (i % 7 - 3) * 5 || ' ms' AS ms,
  i % 3 || CASE WHEN i % 3 = 1 THEN ' segment' ELSE ' segments' END AS plural, CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' WHEN 3 THEN 'a, b and c' ELSE 'a, b, c and ' || i END AS joined,
  CASE i % 4 WHEN 0 THEN '1 x x' WHEN 1 THEN '1 x x, 1 x y' WHEN 2 THEN '2 x x, 1 x y' ELSE '2 x x, 2 x y' END AS counts, 'b' || i || '/c.ts' AS short, 'h' || i || '.example' AS host, '.' || i % 3 || 'ts' AS extension, 'https://h/a/c.ts?d' AS resolved,
  lpad(hex(i), 32, '0') AS iv, lpad(hex(i), 8, '0') AS section, lpad(hex(i), 32, '0') AS sequence_iv, 'text ' || i AS opened, left(sha256('body ' || i), 16) AS digest,
  CASE i % 4 WHEN 0 THEN 'edef8ba9-79d6-4ace-a3c8-27dcd51d21ed' WHEN 1 THEN 'ab-' || i END AS system, 'HIT ' || i AS header, CASE WHEN i % 2 = 0 THEN 'hevc' ELSE 'h264' END AS family, CAST(i % 52 AS DOUBLE) AS level, i % 30 AS object_type,
  CASE WHEN i % 20 IN (0, 2, 3) THEN NULL WHEN i % 20 = 16 THEN 'PQ' WHEN i % 20 = 18 THEN 'HLG' ELSE 'SDR' END AS range
FROM (SELECT event_id AS i FROM events) e""",
}
