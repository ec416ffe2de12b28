"""HLS and DASH readers on manifests whose truth is known by construction."""

import datetime

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from mediaprism import queries
from mediaprism.functions import codecs, text
from mediaprism.plans import manifests as written
from mediaprism.sources import dash, hls

MEDIA = """#EXTM3U
#EXT-X-TARGETDURATION:4
#EXT-X-MEDIA-SEQUENCE:7
#EXT-X-MAP:URI="init.mp4"
#EXT-X-PROGRAM-DATE-TIME:2024-01-01T00:00:00.000Z
#EXTINF:4.0,
#EXT-X-BYTERANGE:100@0
a.mp4
#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x000102030405060708090a0b0c0d0e0f
#EXTINF:3.5,
#EXT-X-BYTERANGE:50
a.mp4
#EXT-X-DISCONTINUITY
#EXT-X-KEY:METHOD=NONE
#EXTINF:4,
b.ts
#EXT-X-ENDLIST
"""
MASTER = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aud",NAME="x, y",URI="a.m3u8",CHANNELS="16/JOC"
#EXT-X-MEDIA:TYPE=CLOSED-CAPTIONS,GROUP-ID="cc",NAME="en",INSTREAM-ID="CC1"
#EXT-X-STREAM-INF:BANDWIDTH=1280000,RESOLUTION=640x360,CODECS="avc1.64001f,mp4a.40.2",AUDIO="aud"
v1.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=2280000,RESOLUTION=640x360
v2.m3u8
"""
MPD = """<MPD type="static" mediaPresentationDuration="PT20S"><Period id="p0" duration="PT10S"><AdaptationSet contentType="video" codecs="avc1.64001f"><SegmentTemplate media="v-$RepresentationID$-$Number%05d$.m4s" initialization="i-$RepresentationID$.mp4" timescale="1000" duration="4000" startNumber="3"/><Representation id="a" bandwidth="100" width="640" height="360" frameRate="30000/1001"/></AdaptationSet></Period>
<Period id="p1"><AdaptationSet mimeType="audio/mp4"><SegmentTemplate media="a-$Time$.m4s" timescale="100"><SegmentTimeline><S t="0" d="200" r="1"/><S d="300" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="b" bandwidth="5"/></AdaptationSet></Period></MPD>"""


def manifests(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "manifest_id int, body string")


def test_hls_segments_carry_state(spark):
    s = hls.segments(manifests(spark, MEDIA)).orderBy("sequence").collect()
    assert [r["sequence"] for r in s] == [7, 8, 9] and [r["uri"] for r in s] == ["a.mp4", "a.mp4", "b.ts"]
    assert [tuple(r["byte_range"]) if r["byte_range"] else None for r in s] == [(0, 100), (100, 50), None]
    assert [r["key_method"] for r in s] == [None, "AES-128", None] and bytes(s[1]["key_iv"]) == bytes(range(16))
    assert [r["discontinuity_sequence"] for r in s] == [0, 0, 1] and all(r["init_uri"] == "init.mp4" for r in s)
    assert s[1]["pdt"] == datetime.datetime(2024, 1, 1, 0, 0, 4) and s[1]["pdt_derived"] and s[2]["pdt"] is None
    p = hls.playlists(manifests(spark, MEDIA, MEDIA.replace("#EXT-X-ENDLIST\n", ""))).orderBy("manifest_id").collect()
    assert [r["live"] for r in p] == [False, True] and p[0]["target_duration"] == 4


def test_hls_renditions(spark):
    r = {x["uri"]: x for x in hls.renditions(manifests(spark, MASTER)).collect()}
    assert r["v1.m3u8"]["name"] == "360p 1280kbps" and r["v1.m3u8"]["kind"] == "video" and r["a.m3u8"]["kind"] == "audio"
    assert r["a.m3u8"]["name"] == "x, y" and r["a.m3u8"]["channels"] == 0
    assert hls.captions(manifests(spark, MASTER)).first()["instream_ids"] == ["CC1"]


def test_dash_periods_and_segments(spark):
    m = manifests(spark, MPD)
    assert [(r["start"], r["duration"]) for r in dash.periods(m).orderBy("period_index").collect()] == [(0, 10), (10, 10)]
    s = dash.segments(m).orderBy("period_index", "sequence").collect()
    assert [r["uri"] for r in s] == ["v-a-00003.m4s", "v-a-00004.m4s", "v-a-00005.m4s", "a-0.m4s", "a-200.m4s", "a-400.m4s", "a-700.m4s"]
    assert [r["declared_start"] for r in s] == [0, 4, 8, 10, 12, 14, 17] and s[0]["init_uri"] == "i-a.mp4"
    assert abs(dash.representations(m).where("kind = 'video'").first()["frame_rate"] - 29.97) < 0.01


def test_scalars(spark):
    row = spark.range(1).select(
        text.attributes(F.lit('A=1,b="x,y",A=2')).alias("a"),
        text.iso_duration(F.lit("P1DT1H2M3.5S")).alias("d"),
        text.iso_duration(F.lit("PT5M")).alias("m"),
        text.human_bytes(F.lit(1536)).alias("b"),
        text.short_target(F.lit("https://h/a/b/c.ts?x=1")).alias("t"),
        text.resolved(F.lit("https://h/a/b.m3u8"), F.lit("../c.ts")).alias("u"),
        hls.kind_of(F.lit("https://h/x"), F.lit("application/dash+xml; charset=utf-8"), F.lit("")).alias("k"),
        codecs.declared_family(F.lit("mp4a.40.2, hvc1.1"), F.lit("video")).alias("f"),
        codecs.avc_profile(F.lit("avc1.64001f")).alias("p"),
        F.hex(text.sequence_iv(F.lit(258))).alias("iv"),
    ).first()
    assert row["a"] == {"A": "2", "B": "x,y"} and row["d"] == 90123.5 and row["m"] == 300 and row["b"] == "1.5 KiB"
    assert row["t"] == "b/c.ts" and row["u"] == "https://h/c.ts" and row["k"] == "dash" and row["f"] == "hevc" and row["p"] == 100
    assert row["iv"] == "0" * 28 + "0102"


def test_aes_round_trip(spark):
    key, iv = F.to_binary(F.lit("00" * 16), F.lit("hex")), text.sequence_iv(F.lit(5))
    whole = F.aes_encrypt(F.lit("some media").cast("binary"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    row = spark.range(1).select(whole.alias("x")).select(text.decrypted(F.expr("substring(x, 17)"), key, iv).cast("string").alias("ok"), text.decrypted(F.expr("substring(x, 18)"), key, iv).alias("bad")).first()
    assert row["ok"] == "some media" and row["bad"] is None


@pytest.mark.parametrize("name", sorted(written.SQL))
def test_reader_agrees_with_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.SQL[name]).df())


def test_window_edges_of_a_live_template(spark):
    mpd = '<MPD type="dynamic" timeShiftBufferDepth="PT60S"><Period start="PT10S"><AdaptationSet contentType="video"><SegmentTemplate media="$Number$.m4s" duration="4" startNumber="1"/><Representation id="a"/></AdaptationSet></Period></MPD>'
    e = dash.window_edges(manifests(spark, mpd), now=110.0).first()
    assert (e["next"], e["oldest"], e["unsupported"]) == (26, 11, False) and e["probes"][0] == 11 and e["probes"][-1] == 25 and len(e["probes"]) == 15
    assert dash.window_edges(manifests(spark, mpd), now=9.0).first()["unsupported"]
    s = dash.segments(manifests(spark, mpd), now=110.0).orderBy("sequence").collect()
    assert [r["sequence"] for r in s] == list(range(14, 26))


def test_attributes_are_found_once_and_no_cast_raises(spark, capsys):
    """Each regular expression stands once in a list's plan, and numbers that are not there are null before the cast."""
    odd = [None, "", "A=1,a=2,B=\"x,y\",A=3", "=,A", 'K="",k=', "A=1,B=2,C=3,B=4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", text.attributes(F.col("t")).alias("a"), text.whole_number(F.col("t"), r"^A=(\d+)").alias("n"))
    got = [(r["a"], r["n"]) for r in df.orderBy("i").collect()]
    assert got == [(None, None), ({}, None), ({"A": "3", "B": "x,y"}, 1), ({}, None), ({"K": ""}, None), ({"A": "1", "B": "4", "C": "3"}, 1)]
    df.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("regexp_extract_all(") == 2
