"""The queries of the engine proper, by name: one a check, the full report and its roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism import findings, sinks
from mediaprism.operators.registry import CHECKS, load, run_checks, shared
from mediaprism.plans import manifests, oracles, relations, scalars, synthetic, synthetic_dash
from mediaprism.plans.stream import from_stream
from mediaprism.sources import dash, hls


def _check(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: CHECKS[name](load(spark, sf_dir, windows=name == "dvr"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_checks(shared(load(spark, sf_dir, windows=True)))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(report(spark, sf_dir))


def report_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).groupBy("check").agg(F.max_by("status", findings.severity(F.col("status"))).alias("worst"), F.count("*").alias("n"))


#: Checks whose findings the renderings below show: their values are whole numbers, which all engines write alike.
_SHOWN = "fetch container tracks ladder".split()


def sink_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_lines(run_checks(load(spark, sf_dir), _SHOWN))


def sink_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = load(spark, sf_dir)
    return sinks.markdown_lines(run_checks(rel, _SHOWN), sinks.run_facts(rel, seconds=4.5))


def sink_prometheus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = load(spark, sf_dir)
    return sinks.prometheus_lines(sinks.metrics(run_checks(rel, _SHOWN), 'a "stream"', sinks.run_facts(rel, seconds=4.5)))


def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's head; its findings counted."""
    rel = load(spark, sf_dir)
    doc = F.from_json("json", "source string, worst string, summary struct<OK:bigint,WARN:bigint,BAD:bigint,ERROR:bigint>, segments bigint, bytes bigint, duration_seconds double, findings array<struct<check:string,status:string>>")
    d = sinks.json_report(run_checks(rel, _SHOWN), "src", sinks.run_facts(rel, seconds=4.5)).select(doc.alias("d"))
    return d.select("d.source", "d.worst", "d.summary.*", "d.segments", "d.bytes", "d.duration_seconds", F.size("d.findings").cast("long").alias("n"), F.get("d.findings", 0)["status"].alias("first"))


def sink_otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a point of the document: family, attributes and value."""
    rel = load(spark, sf_dir)
    attributes = "array<struct<key:string,value:struct<stringValue:string>>>"
    doc = F.from_json("json", f"resourceMetrics array<struct<resource:struct<attributes:{attributes}>,scopeMetrics array<struct<metrics:array<struct<name:string,gauge:struct<dataPoints:array<struct<asDouble:double,attributes:{attributes}>>>>>>>>>".replace("scopeMetrics array", "scopeMetrics:array"))
    d = sinks.otlp_json(sinks.metrics(run_checks(rel, _SHOWN), "s", sinks.run_facts(rel, seconds=4.5))).select(F.explode(doc["resourceMetrics"]).alias("r"))
    m = d.select(F.get("r.resource.attributes", 0)["value"]["stringValue"].alias("stream"), F.explode(F.get("r.scopeMetrics", 0)["metrics"]).alias("m")).select("stream", "m.name", F.explode("m.gauge.dataPoints").alias("p"))
    return m.select("stream", "name", F.array_join(F.transform("p.attributes", lambda a: F.concat(a["key"], F.lit("="), a["value"]["stringValue"])), ",").alias("attributes"), F.col("p.asDouble").alias("value"))


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From manifests and media as bytes to the findings of all checks, over two streams and a further edge."""
    masters, corpus, edge = synthetic.streams(spark, sf_dir)
    return run_checks(from_stream(masters, corpus, edges={"near": edge}))


def dash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from DASH manifests, of templates, indexes and indexes of indexes, and fragmented media."""
    return run_checks(from_stream(*synthetic_dash.presentations(spark, sf_dir)))


def _double(column: str, name: str | None = None) -> Column:
    """Whole numbers that may be null, as engines name their types differently."""
    return F.col(column).cast("double").alias(name or column)


def hls_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hls.segments(manifests.media_playlists(spark, sf_dir))
    return s.select("manifest_id", "sequence", "uri", "duration", "discontinuity", "discontinuity_sequence", _double("byte_range.offset", "range_offset"), _double("byte_range.length", "range_length"), "init_uri", F.unix_micros("pdt").cast("double").alias("pdt_us"), "pdt_derived", "key_method", "key_uri", F.hex("key_iv").alias("key_iv"), "gap")


def hls_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hls.parts(manifests.media_playlists(spark, sf_dir))
    return s.select("manifest_id", "sequence", F.col("idx").cast("long").alias("idx"), "uri", "duration", F.col("byte_range.offset").alias("range_offset"), F.col("byte_range.length").alias("range_length"), "independent", "gap")


def hls_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hls.ad_breaks(manifests.media_playlists(spark, sf_dir))
    return b.select("manifest_id", "tag", "id", "out_of_network", F.unix_micros("start").cast("double").alias("start_us"), _double("at_sequence"), "duration", F.hex("section").alias("section"))


def hls_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.media_playlists(spark, sf_dir)
    hint = hls.preload_hints(m).select("manifest_id", F.col("uri").alias("hint"), F.col("offset").alias("hint_offset"), F.col("sequence").alias("hint_sequence"))
    return hls.playlists(m).join(hint, "manifest_id").select("manifest_id", "master", "live", "target_duration", "media_sequence", "discontinuity_sequence", "part_target", "hint", "hint_offset", "hint_sequence")


def hls_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests.master_playlists(spark, sf_dir)
    r = hls.with_captions(hls.renditions(m), m)
    return r.select("manifest_id", "kind", "uri", "bandwidth", "width", "height", "frame_rate", _double("channels"), F.coalesce("captions_none", F.lit(False)).alias("captions_none"), F.array_join("caption_ids", ",").alias("captions"), "name")


def dash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dash.segments(manifests.presentations(spark, sf_dir))
    return s.select("manifest_id", "period_index", "rep_id", "sequence", "uri", "init_uri", "duration", "declared_start", _double("range_offset"), _double("range_length"))


def dash_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dash.representations(manifests.presentations(spark, sf_dir))
    return r.select("manifest_id", "period_index", "rep_id", "kind", _double("width"), "frame_rate", _double("channels"), "scheme", F.array_join("drm_systems", ",").alias("systems"), F.array_join("drm_in_manifest", ",").alias("inline_systems"), F.array_join("caption_ids", ",").alias("captions"), "addressing", F.col("indexed._indexRange").alias("index_range"))


def dash_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dash.events(manifests.presentations(spark, sf_dir)).drop("content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _check(name) for name in CHECKS} | {"report_summary": report_summary} | {f.__name__: f for f in (scalars.functions, sink_text, sink_markdown, sink_prometheus, sink_json, sink_otlp, stream_report, dash_report, hls_segments, hls_parts, hls_breaks, hls_playlists, hls_renditions, dash_segments, dash_representations, dash_events)}

_ALL = "\nUNION ALL ".join(f"SELECT * FROM ({q})" for q in oracles.SQL.values())
_FOUND = "WITH f AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({oracles.SQL[n]})" for n in _SHOWN) + "), facts AS (" + relations.oracle("SELECT count(*) AS segments, sum(bytes) AS bytes FROM s0 WHERE fetched") + """),
g AS (SELECT *, CASE status WHEN 'OK' THEN 0 WHEN 'WARN' THEN 1 WHEN 'BAD' THEN 2 ELSE 3 END AS sev, CASE WHEN value IS NULL THEN '' ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS shown FROM f),
checks AS (SELECT DISTINCT "check" FROM g), st AS (SELECT unnest(['OK', 'WARN', 'BAD', 'ERROR']) AS status),
m AS (SELECT 'findings' AS name, "check", status, CAST((SELECT count(*) FROM g WHERE g."check" = checks."check" AND g.status = st.status) AS DOUBLE) AS value FROM checks CROSS JOIN st
  UNION ALL SELECT 'check_severity', "check", NULL, max(sev) FROM g GROUP BY 2 UNION ALL SELECT 'worst_severity', NULL, NULL, max(sev) FROM g UNION ALL SELECT 'up', NULL, NULL, (max(sev) < 3)::INT FROM g
  UNION ALL SELECT 'segments', NULL, NULL, segments FROM facts UNION ALL SELECT 'bytes', NULL, NULL, bytes FROM facts UNION ALL SELECT 'duration_seconds', NULL, NULL, 4.5)
"""
_SINKS = {
    "sink_text": """SELECT printf('%s %-6s %-14s %-24s %s %s', CASE status WHEN 'OK' THEN '+' WHEN 'WARN' THEN '!' WHEN 'BAD' THEN 'x' ELSE '?' END, status, "check", target, rule, shown) AS line FROM g
UNION ALL SELECT count(*) FILTER (WHERE sev = 0) || ' OK ' || count(*) FILTER (WHERE sev = 1) || ' WARN ' || count(*) FILTER (WHERE sev = 2) || ' BAD ' || count(*) FILTER (WHERE sev = 3) || ' ERROR' FROM g""",
    "sink_markdown": """SELECT '# Verdict: ' || arg_max(status, sev) AS line FROM g UNION ALL SELECT segments || ' segments, ' || bytes || ' bytes in 4.5 s' FROM facts
UNION ALL SELECT unnest(['## Needs attention', '| status | check | target | rule | value |', '|-|-|-|-|-|']) UNION ALL SELECT '- ' || status || ' ' || "check" || ' ' || target || ' ' || rule FROM g WHERE sev > 0
UNION ALL SELECT '| ' || status || ' | ' || "check" || ' | ' || target || ' | ' || rule || ' | ' || shown || ' |' FROM g""",
    "sink_prometheus": """SELECT 'mediaprism_' || name || '{' || coalesce('check="' || "check" || '",', '') || coalesce('status="' || status || '",', '') || 'stream="a \\"stream\\""} ' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS line FROM m
UNION ALL SELECT DISTINCT '# TYPE mediaprism_' || name || ' gauge' FROM m""",
    "sink_json": """SELECT 'src' AS source, arg_max(status, sev) AS worst, count(*) FILTER (WHERE sev = 0) AS "OK", count(*) FILTER (WHERE sev = 1) AS "WARN", count(*) FILTER (WHERE sev = 2) AS "BAD", count(*) FILTER (WHERE sev = 3) AS "ERROR", any_value(segments) AS segments, CAST(any_value(bytes) AS BIGINT) AS bytes, CAST(4.5 AS DOUBLE) AS duration_seconds, count(*) AS n, arg_max(status, sev) AS first FROM g, facts""",
    "sink_otlp": """SELECT 's' AS stream, 'mediaprism.' || replace(name, '_', '.') AS name, coalesce('check=' || "check", '') || coalesce(',status=' || status, '') AS attributes, value FROM m""",
}
_STREAM = "\nUNION ALL ".join(f"SELECT * FROM ({relations.on(q, synthetic.SEGMENTS, synthetic.RENDITIONS, edges=synthetic.EDGES, probes=synthetic.PROBES)})" for q in oracles.SQL.values())
_DASH = "\nUNION ALL ".join(f"SELECT * FROM ({relations.on(q, synthetic_dash.SEGMENTS, synthetic_dash.RENDITIONS, cues=synthetic_dash.CUES, probes=synthetic_dash.PROBES, breaks=synthetic_dash.BREAKS)})" for q in oracles.SQL.values())
SQL: dict[str, str] = oracles.SQL | manifests.SQL | {
    "stream_report": _STREAM,
    "dash_report": _DASH,
    **scalars.SQL,
    **{n: _FOUND + q for n, q in _SINKS.items()},
    "report_summary": f'SELECT "check", status, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2',
}
