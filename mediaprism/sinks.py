"""Renderings of findings: text, JSON, Markdown, Prometheus and OTLP.

Findings are aggregated on the cluster; a rendering has one row per finding (text, Markdown) or per
check and status (metrics), and is itself a DataFrame of lines or one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaprism.findings import STATUSES, severity

# The mark of each status in texts.
ICONS = {"OK": "+", "WARN": "!", "BAD": "x", "ERROR": "?"}
PREFIX = "mediaprism"


def _icon():
    return F.element_at(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv]), F.col("status"))


def _shown(value):
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", ""))


def text_lines(findings: DataFrame) -> DataFrame:
    """Aligned lines, worst first, and a summary line at the end; ordered by ``n``."""
    rows = findings.select(F.struct((-severity(F.col("status"))).alias("s"), "check", "target", "rule").alias("key"), F.format_string("%s %-6s %-14s %-24s %s %s", _icon(), "status", "check", "target", "rule", _shown(F.col("value"))).alias("line"))
    counts = findings.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
    last = counts.select(F.struct(F.lit(1).alias("s"), F.lit("").alias("check"), F.lit("").alias("target"), F.lit("").alias("rule")).alias("key"), F.format_string(" ".join(f"%d {s}" for s in STATUSES), *STATUSES).alias("line"))
    return rows.unionByName(last).orderBy("key").select("line")


def json_lines(findings: DataFrame, source: str) -> DataFrame:
    """One JSON document per finding, with the run's source; null values are left out."""
    return findings.select(F.to_json(F.struct(F.lit(source).alias("source"), *findings.columns)).alias("json"))


def run_facts(rel, started: float | None = None, seconds: float | None = None) -> DataFrame:
    """One row about a run: segments and bytes fetched, and when it began and how long it took (seconds), where known."""
    fetched = rel.all_segments.where("fetched")
    return fetched.agg(F.count("*").alias("segments"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select("segments", "bytes", F.lit(started).cast("double").alias("started"), F.lit(seconds).cast("double").alias("duration_seconds"))


def json_report(findings: DataFrame, source: str, facts: DataFrame | None = None) -> DataFrame:
    """The whole run as one JSON document: source, worst, summary, run facts, findings. For one stream's findings, which one row holds; for many take ``json_lines``."""
    worst = F.coalesce(F.max_by("status", severity(F.col("status"))), F.lit("OK"))
    ordered = F.array_sort(F.collect_list(F.struct((-severity(F.col("status"))).alias("order"), *findings.columns)))
    counts = F.struct(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
    row = findings.agg(worst.alias("worst"), counts.alias("summary"), ordered.alias("f"))
    more = [] if facts is None else facts.columns
    row = row if facts is None else row.join(F.broadcast(facts))
    return row.select(F.to_json(F.struct(F.lit(source).alias("source"), "worst", "summary", *more, F.transform("f", lambda x: F.struct(*[x[c].alias(c) for c in findings.columns])).alias("findings"))).alias("json"))


def markdown_lines(findings: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A verdict, the run's facts, what needs attention, and the whole table, worst first; pipes are escaped. Lines in the order of ``n``."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    key = lambda part, s=0: F.struct(F.lit(part).alias("part"), F.lit(s).alias("s") if isinstance(s, int) else s.alias("s"), "check", "target", "rule")
    blank = [F.lit("").alias(c) for c in ("check", "target", "rule")]
    own = (-severity(F.col("status"))).cast("int")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "status", cell(F.col("check")), cell(F.col("target")), cell(F.col("rule")), _shown(F.col("value"))), F.lit(" |"))
    rows = findings.select(key(5, own).alias("key"), row.alias("line"))
    urgent = findings.where("status <> 'OK'").select(key(3, own).alias("key"), F.concat(F.lit("- "), F.concat_ws(" ", "status", "check", "target", "rule")).alias("line"))
    worst = findings.agg(F.coalesce(F.max_by("status", severity(F.col("status"))), F.lit("OK")).alias("w")).select(F.concat(F.lit("# Verdict: "), "w").alias("line"), *blank).select(key(0).alias("key"), "line")
    fixed = findings.sparkSession.sql("SELECT * FROM VALUES (2, 0, '## Needs attention'), (4, 0, '| status | check | target | rule | value |'), (4, 1, '|-|-|-|-|-|') AS t(part, s, line)")
    fixed = fixed.select(F.struct("part", "s", *blank).alias("key"), "line")
    out = worst.unionByName(fixed).unionByName(urgent).unionByName(rows)
    if facts is not None:
        told = facts.select(F.concat(F.col("segments").cast("string"), F.lit(" segments, "), F.col("bytes").cast("string"), F.lit(" bytes"), F.coalesce(F.concat(F.lit(" in "), _shown(F.col("duration_seconds")), F.lit(" s")), F.lit(""))).alias("line"), *blank)
        out = out.unionByName(told.select(key(1).alias("key"), "line"))
    return out.orderBy("key").select("line")


def metrics(findings: DataFrame, stream: str, facts: DataFrame | None = None) -> DataFrame:
    """name, labels (map) and value: the counts of every check and status, zeros included, severities, and the run's facts that are known."""
    checks = findings.select("check").distinct()
    counts = findings.groupBy("check", "status").agg(F.count("*").alias("n"))
    grid = checks.withColumn("status", F.explode(F.array(*[F.lit(s) for s in STATUSES]))).join(counts, ["check", "status"], "left")
    label = lambda *kv: F.create_map(F.lit("stream"), F.lit(stream), *[x if not isinstance(x, str) else F.lit(x) for x in kv])
    one = lambda name, labels, value: (F.lit(f"{PREFIX}_{name}").alias("name"), labels.alias("labels"), value.cast("double").alias("value"))
    worst = findings.agg(F.coalesce(F.max(severity(F.col("status"))), F.lit(0)).alias("w"))
    samples = (
        grid.select(*one("findings", label("check", F.col("check"), "status", F.col("status")), F.coalesce("n", F.lit(0))))
        .unionByName(findings.groupBy("check").agg(F.max(severity(F.col("status"))).alias("w")).select(*one("check_severity", label("check", F.col("check")), F.col("w"))))
        .unionByName(worst.select(*one("worst_severity", label(), F.col("w"))))
        .unionByName(worst.select(*one("up", label(), (F.col("w") < 3).cast("int"))))
    )
    for column, name in () if facts is None else (("segments", "segments"), ("bytes", "bytes"), ("duration_seconds", "duration_seconds"), ("started", "start_time_seconds")):
        samples = samples.unionByName(facts.where(F.col(column).isNotNull()).select(*one(name, label(), F.col(column))))
    return samples


def prometheus_lines(samples: DataFrame) -> DataFrame:
    """Exposition format, label values escaped, families together under their TYPE line."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    rows = samples.select("name", F.lit(1).alias("k"), F.concat("name", F.lit("{"), labels, F.lit("} "), _shown(F.col("value"))).alias("line"))
    heads = samples.select("name").distinct().select("name", F.lit(0).alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")).alias("line"))
    return heads.unionByName(rows).orderBy("name", "k", "line").select("line")


def otlp_json(samples: DataFrame) -> DataFrame:
    """One OTLP metrics document; the stream is an attribute of the resource, not of the points."""
    attribute = lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value"))
    points = samples.select(F.replace("name", F.lit("_"), F.lit(".")).alias("name"), F.element_at("labels", "stream").alias("stream"), F.struct(F.col("value").alias("asDouble"), F.transform(F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != "stream"))), attribute).alias("attributes")).alias("point"))
    families = points.groupBy("stream", "name").agg(F.struct(F.sort_array(F.collect_list("point")).alias("dataPoints")).alias("gauge"))
    whole = families.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("name", "gauge"))).alias("metrics"))
    resource = F.struct(F.array(F.struct(F.lit("stream").alias("key"), F.struct(F.col("stream").alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.lit(PREFIX).alias("name"))
    return whole.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(scope.alias("scope"), "metrics")).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("json"))
