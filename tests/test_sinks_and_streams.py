"""Renderings, the fetch source on a corpus, and streaming against batch."""

import json
import time

from conftest import SF
from pyspark.sql import functions as F

from mediaprism import sinks
from mediaprism.operators.registry import load
from mediaprism.operators.timing import watch
from mediaprism.sources.fetch import byte_range, from_corpus
from mediaprism.streaming.polls import PollSource
from mediaprism.streaming.watch import watch_stream


def found(spark):
    return spark.createDataFrame([("fetch", "segment", "r1|x", "BAD", 2.5), ("init", "ok", "r2", "OK", None)], "check string, rule string, target string, status string, value double")


def test_texts(spark):
    lines = [r["line"] for r in sinks.text_lines(found(spark)).collect()]
    assert lines[0].startswith("x BAD") and lines[-1] == "1 OK 0 WARN 1 BAD 0 ERROR"
    table = [r["line"] for r in sinks.markdown_lines(found(spark)).collect()]
    assert table[0] == "# Verdict: BAD" and table[2].startswith("- BAD fetch") and table[3].startswith("| status") and "r1\\|x" in table[5] and len(table) == 7
    facts = spark.createDataFrame([(3, 100, 5.0, 1.25)], "segments long, bytes long, started double, duration_seconds double")
    assert [r["line"] for r in sinks.markdown_lines(found(spark), facts).collect()][1] == "3 segments, 100 bytes in 1.25 s"
    assert {r["name"] for r in sinks.metrics(found(spark), "s", facts).collect()} >= {f"mediaprism_{n}" for n in ("segments", "bytes", "duration_seconds", "start_time_seconds")}
    report = json.loads(sinks.json_report(found(spark), "s").first()["json"])
    assert report["worst"] == "BAD" and report["summary"] == {"OK": 1, "WARN": 0, "BAD": 1, "ERROR": 0} and report["findings"][0]["check"] == "fetch"


def test_metrics(spark):
    samples = sinks.metrics(found(spark), 's"1')
    lines = [r["line"] for r in sinks.prometheus_lines(samples).collect()]
    assert 'mediaprism_findings{check="init",status="BAD",stream="s\\"1"} 0' in lines
    assert 'mediaprism_worst_severity{stream="s\\"1"} 2' in lines
    doc = json.loads(sinks.otlp_json(samples).first()["json"])
    resource = doc["resourceMetrics"][0]
    assert resource["resource"]["attributes"][0]["key"] == "stream"
    assert all(a["key"] != "stream" for m in resource["scopeMetrics"][0]["metrics"] for p in m["gauge"]["dataPoints"] for a in p.get("attributes", []))


def test_fetch_from_corpus(spark):
    requests = spark.createDataFrame([("a", None, None), ("a", 1, 2), ("b", None, None), ("c", None, None)], "uri string, offset long, length long")
    corpus = spark.createDataFrame([("a", 200, bytearray(b"12345")), ("b", 404, bytearray(b"no"))], "uri string, status int, body binary")
    rows = {(r["uri"], r["offset"]): r for r in from_corpus(requests, corpus, cap=3).collect()}
    whole, part = rows["a", None], rows["a", 1]
    assert whole["truncated"] and bytes(whole["body"]) == b"123" and whole["error"] is None and (part["status"], bytes(part["body"]), part["truncated"]) == (206, b"23", False)
    assert rows["b", None]["error"] == "status 404" and bytes(rows["b", None]["body"]) == b"no" and rows["c", None]["error"] == "no answer"
    assert requests.limit(1).select(byte_range(F.lit(5), F.lit(10)).alias("r")).first()["r"] == "bytes=5-14"


def run_stream(spark, series, tmp_path, parts):
    """The series as that many files in turn, each with whatever rows it is given, and a last one far on that lets all others count."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k:02d}"))
    far = spark.createDataFrame([(-1, 0, 10**13, [], [], 2_000_000, False)], series.schema)
    for k in (90, 91):
        far.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = watch_stream(stream, late="1000 seconds").writeStream.format("memory").queryName("edge").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.sql("SELECT * FROM edge WHERE rendition >= 0").collect()


def test_stream_says_what_the_batch_says_though_rows_come_late(spark, tmp_path):
    from dataclasses import replace

    rel = load(spark, SF)
    series = rel.observations.where("rendition % 3 = 0")
    # Later polls come in the first file, earlier ones in the second.
    out = run_stream(spark, series, tmp_path, [series.where("poll % 3 = 1"), series.where("poll % 3 <> 1")])
    last = {f"r{r['rendition']}": r for r in sorted(out, key=lambda r: r["looks"] + r["failures"])}
    batch = {r["target"]: r for r in watch(replace(rel, observations=series)).where("rule IN ('advancing', 'stalled', 'one-look', 'no-interval')").collect()}
    assert batch and set(batch) <= set(last)
    for name, r in batch.items():
        assert (last[name]["rule"], last[name]["stall_us"] / 1e6) == (r["rule"], r["value"])
    assert any(r["silent"] for r in out)
    other = {r["target"]: r["rule"] for r in watch(replace(rel, observations=series)).where("rule IN ('behind', 'ahead', 'backwards', 'empty', 'never-advanced')").collect()}
    for name, rule in other.items():
        x = last[name]
        assert rule in (x["rate"], x["rule"]) or (rule == "backwards" and x["backwards"] > 0)


def test_polls_go_on_where_they_stopped(spark, tmp_path):
    """A folder of polls: three are read, then, after a restart from the checkpoint, the other two; none is lost or comes twice."""
    for poll in range(1, 6):
        body = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n" + "".join(f"#EXTINF:2.0,\n{k}.ts\n" for k in range(poll, poll + 3))
        (tmp_path / f"a{poll}.m3u8").write_text(body)
    spark.dataSource.register(PollSource)
    lists = f"7 {tmp_path}/a{{poll}}.m3u8\n8 {tmp_path}/none.m3u8"
    for polls in (3, 5):
        source = spark.readStream.format("live_polls").option("playlists", lists).option("interval", "0.1").option("polls", str(polls)).load()
        q = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        for _ in range(300):
            time.sleep(0.1)
            if q.lastProgress and q.lastProgress["sources"][0]["endOffset"] and json.loads(str(q.lastProgress["sources"][0]["endOffset"]).replace("'", '"'))["poll"] >= polls:
                break
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r["poll"], [u.rsplit("/", 1)[1] for u in r["uris"]], r["durations_us"], r["target_us"]) for r in rows if r["rendition"] == 7)
    assert got == [(p, [f"{k}.ts" for k in range(p, p + 3)], [2_000_000] * 3, 2_000_000) for p in range(1, 6)]
    assert sorted((r["poll"], r["failed"]) for r in rows if r["rendition"] == 8) == [(p, True) for p in range(1, 6)]
