"""Streams side by side, samples of fragments, sealed streams, indexes, retention, addresses, and what once was cut."""

import struct
from dataclasses import replace
from urllib.parse import urljoin

import media_builder as build
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from mediaprism.functions.text import resolved
from mediaprism.media import indexes, samples
from mediaprism.media.containers import parse, parse_mp4, parse_ts
from mediaprism.operators import retention
from mediaprism.operators.registry import EMPTY, load, run_checks, shared
from mediaprism.plans import stream, synthetic, synthetic_dash
from mediaprism.queries import QUERIES, SQL
from mediaprism.sources import dash, indexed
from mediaprism.sources.fetch import from_corpus


def test_streams_together_say_what_each_says_alone(spark):
    whole = shared(load(spark, SF, windows=True))
    both = whole.all_renditions.where("stream IN (0, 1)")

    def of(streams):
        r = both.where(F.col("stream").isin(streams))
        own = {k: getattr(whole, k).join(r.select("rendition"), "rendition", "left_semi") for k in EMPTY if k not in ("probes", "clocks")}
        own["clocks"] = whole.clocks.where(F.col("stream").isin(streams))
        return replace(whole, all_renditions=r, all_segments=whole.all_segments.where(F.col("stream").isin(streams)), **own)

    together, alone = rows_of(run_checks(of([0, 1])).toPandas()), sorted(rows_of(run_checks(of([0])).toPandas()) + rows_of(run_checks(of([1])).toPandas()))
    assert together == alone and len({r.split(",")[0] for r in together}) > 25


def test_dash_report_agrees_with_sql(spark, duck):
    got = QUERIES["dash_report"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(SQL["dash_report"]).df())
    assert {"unparseable", "none", "late", "missing", "start", "outside", "partial", "agrees"} <= set(got["rule"])


def test_no_edge_no_finding_and_all_checks_run(spark):
    masters, corpus, edge = synthetic.streams(spark, SF)
    rel = stream.from_stream(masters.where("manifest_id = 1"), corpus, rungs=2, sample=3)
    found = run_checks(rel).select("check").distinct().collect()
    assert "pop" not in {r["check"] for r in found} and rel.all_renditions.count() == 2 and rel.all_segments.groupBy("rendition").count().where("count > 3").count() == 0


# --- samples


def test_samples_of_fragments():
    text = synthetic_dash.fragment("text", 90_000, None, False, False)
    assert parse_mp4(text, synthetic_dash.init("text", 0, 0))["cues"] == [(1000, 2000)]
    video = parse_mp4(synthetic_dash.fragment("video", 0, 4, True, True), synthetic_dash.init("video", 320, 176))["tracks"][0]
    assert (video["captions"], video["opens_on_keyframe"], video["has_keyframe"]) == (["SERVICE1", "field1"], False, True)
    assert parse_mp4(synthetic_dash.fragment("video", 0, None, False, False), synthetic_dash.init("video", 320, 176))["tracks"][0]["captions"] == []


def test_samples_at_a_stated_base_and_one_run_after_another():
    """Sizes from the header's default; the second run goes on where the first ended; a sample beyond the bytes is left out."""
    pair = lambda kind, x: build.box(kind, x)
    bodies = [pair(b"cdat", b"\x41\x42"), pair(b"cdt2", b"\x80\x80"), pair(b"cdt2", b"\x43\x44")]
    media = b"".join(bodies)
    init = build.mp4_init().replace(b"avc1", b"c608")
    tfdt = build.box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", 0))
    head = lambda base: build.box(b"moof", build.box(b"traf", build.box(b"tfhd", struct.pack(">IIQI", 0x11, 1, base, len(bodies[0]))), tfdt, build.box(b"trun", struct.pack(">IIi", 1, 2, 0)), build.box(b"trun", struct.pack(">II", 0, 2))))
    data = head(len(head(0)) + 8) + build.box(b"mdat", media)
    assert parse_mp4(data, init)["tracks"][0]["captions"] == ["field1", "field2"]
    assert samples.track_captions([build.box(b"ccdp", b"\x02\x21\xff\x00")], "c708") and not samples.track_captions([b"\0\0\0\1"], "c608") and not samples.is_cue(build.box(b"vtte"))


def test_sealed_streams_say_nothing_of_their_samples():
    plain = build.ts(900_000)
    sealed = plain.replace(b"\x1b\xe1\x01\xf0\x00", b"\xdb\xe1\x01\xf0\x00")
    got = parse_ts(sealed)
    assert got["sealed"] and not parse_ts(plain)["sealed"]
    t = got["tracks"][0]
    assert (t["min_pts"], t["opens_on_keyframe"], t["captions"], t["protection"]) == (900_000, None, None, "sample-aes")


def test_captions_and_splices_beyond_what_once_was_looked_at(spark):
    from mediaprism.media.captions import seen

    unit = synthetic_dash._captions(True, False)[4:]
    late = b"\0\0\1\x41\x88" * 5000 + b"\0\0\1" + unit
    assert seen(late, "h264") == ["field1"]
    cues = "WEBVTT\n\n" + "\n\n".join(f"{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}.000 --> {k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}.500\nx" for k in range(100_001))
    assert len(parse(cues.encode())["cues"]) == 100_001


# --- indexes, manifests, retention


def test_indexes_of_indexes(spark):
    bodies = [b"%05d" % k * (k % 3 + 1) for k in range(20)]
    whole, at, size = synthetic_dash.single_file(bodies, True, 320, 176)
    corpus = spark.createDataFrame([("f", 200, bytearray(whole))], "uri string, status int, body binary")
    asked = spark.createDataFrame([(1, "f", at, size), (2, "none", 0, 9)], "id long, uri string, offset long, length long")
    got = indexed.expand(asked, lambda r: from_corpus(r, corpus)).orderBy("n").collect()
    assert [whole[r["range_offset"] : r["range_offset"] + r["range_length"]] for r in got] == bodies and [r["ticks"] for r in got] == [k * 180_000 for k in range(20)]
    top = indexes.sidx(whole[at : at + size], at)
    assert [e["offset"] for e in indexes.expand(top, lambda o, n: whole[o : o + n])] == [r["range_offset"] for r in got]


def _mpd(kind, rest):
    return f'<MPD {kind}><Period>{rest}</Period></MPD>'


def test_long_and_live_templates(spark):
    template = '<AdaptationSet contentType="video"><Representation id="v" bandwidth="1"><SegmentTemplate timescale="1" duration="2" media="$Number$.m4s"/></Representation></AdaptationSet>'
    rows = [(1, _mpd('type="static" mediaPresentationDuration="PT20H"', template)), (2, _mpd('type="dynamic" availabilityStartTime="2020-01-01T00:00:00Z"', template))]
    s = dash.segments(spark.createDataFrame(rows, "manifest_id long, body string"))
    n = {r["manifest_id"]: r["count"] for r in s.groupBy("manifest_id").count().collect()}
    assert n == {1: 36_000, 2: 12}
    with pytest.raises(Exception, match="a representation of"):
        dash.segments(spark.createDataFrame(rows, "manifest_id long, body string"), most=35_999).count()


def test_retention_is_found_by_halves(spark):
    segments = spark.createDataFrame([(u, u, q, 2_000_000 + q) for u in range(6) for q in range(30 if u < 4 else 1)], "stream long, rendition long, sequence long, declared_us long")
    r = spark.createDataFrame([(u, u, "video", 9, True, False) for u in range(6)], "stream long, rendition long, kind string, bandwidth long, live boolean, failed boolean")
    first = {0: 0, 1: 7, 2: 29, 3: 99, 4: 0, 5: 99}  # the oldest segment that is there
    windows = retention.windows_of(r, segments)
    held = spark.createDataFrame(list(first.items()), "rendition long, since long")
    got = {x["rendition"]: x for x in retention.measure(windows, lambda a: a.join(held, "rendition").select("rendition", (F.col("sequence") >= F.col("since")).alias("held"))).collect()}
    places = [p["sequence"] for p in windows.where("rendition = 1").first()["points"]]
    assert len(places) == 16 and places[0] == 0 and places[-1] == 29
    found = next(p for p in places if p >= 7)
    assert got[0]["held"] and got[4]["held"] and got[0]["fetches"] == 1 and not got[1]["held"]
    assert got[1]["since_us"] == sum((b - a) * (2_000_000 + a) for a, b in zip(places, places[1:]) if a >= found)
    assert got[2]["since_us"] in (0, 2_000_029) and got[3]["since_us"] == 0 and got[5]["since_us"] is None and all(x["fetches"] <= 5 for x in got.values())


def test_addresses_resolve_as_the_standard_says(spark):
    bases = ["https://h.example/a/b/c.m3u8?x=1#f", "https://h.example", "http://h:81/a/", ""]
    references = ["d.ts", "../d.ts?q", "../../../d.ts", "./d.ts", "/r/../s.ts", "//o.example/x", "https://o/x/../y", "?z=2", "#g", "", "a/./b/../c", "..", "."]
    rows = [(b, r) for b in bases for r in references]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", resolved(F.col("b"), F.col("r")).alias("x")).collect()
    assert [(x["b"], x["r"], x["x"]) for x in got] == [(b, r, urljoin(b, r) if b else r) for b, r in rows]


# --- the clock


def test_time_sources_and_the_next_segment(spark):
    template = '<Period><AdaptationSet contentType="video"><Representation id="v" bandwidth="1"><SegmentTemplate timescale="1" duration="2" media="$Number$.m4s"/></Representation></AdaptationSet></Period>'
    named = lambda *s: "".join(f'<UTCTiming schemeIdUri="urn:mpeg:dash:utc:{k}:2014" value="{v}"/>' for k, v in s)
    live = lambda sources: f'<MPD type="dynamic" availabilityStartTime="2024-01-01T00:00:00Z">{sources}{template}</MPD>'
    rows = [
        (1, live(named(("direct", "2024-01-01T00:01:00Z")))),
        (2, live(named(("ntp", "x"), ("http-iso", "http://t/none"), ("http-head", "http://t/head")))),
        (3, live(named(("ntp", "x")))),
        (4, live("")),
        (5, live(named(("http-xsdate", "http://t/body")))),
    ]
    manifests = spark.createDataFrame([(n, "http://h/m.mpd", b) for n, b in rows], "manifest_id long, url string, body string")
    headers = {"Date": ["Mon, 01 Jan 2024 00:02:00 GMT"]}
    bodies = [("http://t/head", b"x", headers), ("http://t/body", b" 2024-01-01T00:03:00Z\n", {}), ("http://h/31.m4s", b"early", {}), ("http://h/60.m4s", b"last", {})]
    corpus = spark.createDataFrame([(u, 200, bytearray(b), h) for u, b, h in bodies], "uri string, status int, body binary, headers map<string,array<string>>")
    asked = []

    def fetch(requests):
        asked.append(requests.count())
        return from_corpus(requests, corpus)

    rel = stream.relations(stream.dash_listing(manifests, fetch), fetch)
    at = 1_704_067_200
    clocks = {r["stream"]: (r["sources"], r["spoken"], r["now_us"] and r["now_us"] // 1_000_000 - at) for r in rel.clocks.collect()}
    assert clocks == {1: (1, True, 60), 2: (3, True, 120), 3: (1, False, None), 5: (1, True, 180)} and asked[0] == 3
    newest = {r["stream"]: r["n"] for r in rel.all_segments.groupBy("stream").agg(F.max("sequence").alias("n")).collect()}
    assert (newest[1], newest[2], newest[5]) == (30, 60, 90)
    found = {(r["rule"], r["target"]) for r in run_checks(rel, ["availability"]).collect()}
    assert {("clock-off", "s1/clock"), ("clock-unsupported", "s3/clock"), ("no-clock", "s4/clock"), ("next-served", "r100001"), ("newest-missing", "r100001"), ("there", "r200001")} <= found
    assert not any(rule == "next-served" and target != "r100001" for rule, target in found)
