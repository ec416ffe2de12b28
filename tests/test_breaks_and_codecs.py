"""Codec strings taken apart, breaks that manifests declare with their sections, and cues behind a segment that was not read."""

import base64

import pytest
from pyspark.sql import functions as F
from test_parsers import splice_insert

from mediaprism.functions.codecs import declared_video
from mediaprism.operators import content, timing
from mediaprism.operators.common import Relations
from mediaprism.plans import stream
from mediaprism.sources import dash
from mediaprism.sources.fetch import from_corpus

STRINGS = {
    "avc1.640028": (100, 40, None), "avc3.4D401F": (77, 31, None), "avc1.66.30": (66, 30, None), "avc1.66.0.30": (66, 30, None), "hvc1.2.4.L153.B0": (2, 153, 0), "hev1.A1.6.H120": (1, 120, 1), "hvc1.2": (2, None, None), "hvc1.x.4.L93": (None, 93, 0),
    "av01.0.13M.08": (0, 13, 0), "av01.1.08H.10": (1, 8, 1), "av01.0.08": (0, 8, None), "vp09.02.31.10": (2, 31, None), "mp4a.40.2, avc1.64001f": (100, 31, None), "dvh1.05.01,hvc1.1.6.L90": (1, 90, 0),
    "dvh1.05.01": None, "avc1": None, "avc1.zz": None, "avc1.64001": None, "hvc1.x.y": None, "mp4a.40.2": None, "": None,
}


def test_codec_strings_are_taken_apart(spark):
    rows = spark.createDataFrame([(s,) for s in [*STRINGS, None]], "s string").select("s", declared_video(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] and tuple(r["d"]) for r in rows} == STRINGS | {None: None}


def _told(spark, said, profile, level, tier):
    s = spark.createDataFrame([(0, 1, "video", 0, True, profile, level, tier, "hevc", None, None)], "stream long, rendition long, kind string, sequence long, parsed boolean, profile_idc long, level_idc long, tier long, codec string, object_type long, sbr boolean")
    r = spark.createDataFrame([(0, 1, said, False)], "stream long, rendition long, codecs string, failed boolean")
    return sorted((x["rule"], x["status"], x["value"]) for x in content.codecstring(Relations(s, r)).collect())


@pytest.mark.parametrize(
    ("said", "media", "found"),
    [
        ("hvc1.2.4.L93.B0", (2, 93, 0), [("agrees", "OK", 93.0)]),
        ("hvc1.1.6.H90.B0", (2, 93, 0), [("level-understated", "BAD", 93.0), ("profile-understated", "BAD", 2.0), ("tier-differs", "WARN", 0.0)]),
        ("hvc1.2.4.L120.B0", (1, 93, 0), [("level-overstated", "WARN", 93.0), ("profile-overstated", "WARN", 1.0)]),
        ("hvc1.2", (2, 93, 1), [("agrees", "OK", 93.0)]),
        ("av01.0.08H.08", (0, 8, None), [("agrees", "OK", 8.0)]),
        ("dvh1.05.01", (2, 93, 0), [("undecomposable", "OK", 93.0)]),
        ("", (2, 93, 0), []),
        ("hvc1.2.4.L93.B0", (None, None, None), []),
    ],
)
def test_each_part_of_a_codec_string_is_told_of_its_own(spark, said, media, found):
    assert _told(spark, said, *media) == found


def _fetch(spark):
    corpus = spark.createDataFrame([("none", 200, bytearray(b""))], "uri string, status int, body binary")
    return lambda requests: from_corpus(requests, corpus)


def test_breaks_of_playlists_carry_their_sections(spark):
    section = splice_insert(77, 900_000)
    ranged = lambda name, x: f'#EXT-X-DATERANGE:ID="{name}",START-DATE="2024-01-01T00:00:00Z",SCTE35-OUT=0x{x.hex()}'
    body = "\n".join(["#EXTM3U", "#EXT-X-TARGETDURATION:2", ranged("a", section), "#EXTINF:2,", "a.ts", "#EXT-X-CUE-OUT:30", "#EXTINF:2,", "b.ts", ranged("b", b"\xff\0"), "#EXTINF:2,", "c.ts", "#EXT-X-ENDLIST"])
    manifests = spark.createDataFrame([(3, "http://h/a.m3u8", body)], "manifest_id long, url string, body string")
    rows = stream.hls_listing(manifests, _fetch(spark)).breaks.collect()
    at = 1_704_067_200_000_000
    assert sorted(((r["event"], r["section_pts"], r["at_sequence"], r["clock_us"]) for r in rows), key=str) == sorted([(77, 900_000, None, at), (None, None, 1, None), (None, None, None, at)], key=str)
    assert {r["rendition"] for r in rows} == {300_001} and len({r["break"] for r in rows}) == 3


def test_events_of_presentations_are_breaks_on_the_media_clock(spark):
    """An event counts from its period; the media stands at its time offset there. Other schemes are no breaks, and no time is no place."""
    coded = base64.b64encode(splice_insert(78, 450_000)).decode()
    template = lambda pto: f'<AdaptationSet contentType="video"><SegmentTemplate timescale="1000" duration="2000" presentationTimeOffset="{pto}" media="$Number$.m4s"/><Representation id="v" bandwidth="2"/><Representation id="w" bandwidth="1"/></AdaptationSet><AdaptationSet contentType="audio"><Representation id="a" bandwidth="1"><SegmentTemplate timescale="1000" duration="2000" media="a$Number$.m4s"/></Representation></AdaptationSet>'
    first = f'<EventStream schemeIdUri="urn:SCTE:scte35:2014:xml+bin"><Event presentationTime="3" id="x"><scte35:Signal xmlns="urn:x"><scte35:Binary>\n {coded[:8]}\n{coded[8:]} </scte35:Binary></scte35:Signal></Event></EventStream><EventStream schemeIdUri="urn:other"><Event presentationTime="1"/></EventStream>'
    second = f'<EventStream schemeIdUri="urn:scte:scte35:2013:bin" timescale="10" presentationTimeOffset="20"><Event presentationTime="50">{coded}</Event><Event>not a section</Event></EventStream>'
    body = f'<MPD type="static"><Period duration="PT10S">{first}{template(0)}</Period><Period duration="PT10S">{second}{template(5000)}</Period></MPD>'
    manifests = spark.createDataFrame([(1, "http://h/m.mpd", body), (2, "http://h/n.mpd", f'<MPD type="static"><Period duration="PT10S">{template(0)}</Period></MPD>')], "manifest_id long, url string, body string")
    told = {r["n"]: (r["period_index"], r["offset"], r["section"] is not None) for r in dash.ad_breaks(manifests).collect()}
    # The third holds some bytes, of which only the parser can say that they are no section.
    assert told == {1: (0, 3.0, True), 2: (1, 3.0, True), 3: (1, None, True)}
    listing = stream.dash_listing(manifests, _fetch(spark))
    names = {r["rendition"] for r in listing.renditions.where("kind = 'video' AND stream = 1").collect()}
    got = sorted(((r["rendition"], r["break"], r["media_us"], r["event"], r["section_pts"]) for r in listing.breaks.collect()), key=str)
    assert len(names) == 2 and got == sorted([(n, *x) for n in names for x in ((1, 3_000_000, 78, 450_000), (2, 8_000_000, 78, 450_000), (3, None, None, None))], key=str)


def _subtitles(spark, begin_us):
    s = spark.createDataFrame(
        [(0, 1, "video", 0, True, 2_000_000, True, 900_000)] + [(0, 2, "text", q, q != 1, 2_000_000, True, None) for q in range(3)],
        "stream long, rendition long, kind string, sequence long, parsed boolean, declared_us long, mapped boolean, min_pts long",
    ).withColumn("timescale", F.lit(90_000).cast("long"))
    r = spark.createDataFrame([(0, n, False) for n in (1, 2)], "stream long, rendition long, failed boolean")
    cues = spark.createDataFrame([(2, 0, 10_000_000, 11_000_000), (2, 2, begin_us, begin_us + 500_000)], "rendition long, sequence long, begin_us long, end_us long")
    return [(x["rule"], x["target"], x["value"]) for x in timing.subtitles(Relations(s, r, cues=cues)).collect()]


def test_cues_behind_a_segment_that_was_not_read_are_in_their_place(spark):
    assert _subtitles(spark, 14_100_000) == [("inside", "r2", 2.0)]
    assert _subtitles(spark, 12_100_000) == [("outside", "r2/2", -1.9)]


def test_sections_count_ninety_thousand_ticks_whatever_the_media_does(spark):
    """Media of 1,000 ticks a second: the section's clock is brought to it before both are compared."""
    s = spark.createDataFrame([(0, 1, "video", q, True, 10_000 + q * 2000, 2_000_000, None) for q in range(3)], "stream long, rendition long, kind string, sequence long, parsed boolean, min_pts long, measured_us long, pdt_us long").withColumn("timescale", F.lit(1000).cast("long"))
    r = spark.createDataFrame([(0, 1, False)], "stream long, rendition long, failed boolean")
    splices = spark.createDataFrame([(1, 1, 77, 12_000), (2, 1, 78, 14_000)], "splice long, rendition long, event long, pts long")
    breaks = spark.createDataFrame([(1, 1, 77, None, 12_000_000, None, None, 1_080_000), (2, 1, 78, None, 14_500_000, None, None, 1_350_000)], "break long, rendition long, event long, media_pts long, media_us long, at_sequence long, clock_us long, section_pts long")
    found = sorted((x["rule"], x["target"], x["value"]) for x in timing.adbreak(Relations(s, r, splices=splices, breaks=breaks)).collect())
    assert found == [("break-off-boundary", "r1@b2", 500.0), ("break-on-boundary", "r1@b1", 0.0), ("section-differs", "r1@b2", 1000.0), ("splice-on-boundary", "r1@1", 0.0), ("splice-on-boundary", "r1@2", 0.0)]
