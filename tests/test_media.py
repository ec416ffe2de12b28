"""Parsers on built media, damaged media, and a round trip from table rows through bytes."""

import random

import media_builder as build
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediaprism.media import bits, containers, indexes, splices, stage


def test_parameter_sets():
    for w, h, p in ((640, 360, 77), (1920, 1080, 100), (416, 234, 77), (16, 16, 100)):
        s = bits.avc_sps(build.sps(w, h, p))
        assert (s.width, s.height, s.profile, s.level) == (w, h, p, 31)
        assert bits.avc_sps(build.sps(w, h, p)[:5]) is None


def test_transport_stream():
    t = containers.parse(build.ts(90_000))["tracks"][0]
    assert (t["kind"], t["codec"], t["min_pts"], t["max_pts"], t["samples"], t["frame_dur"]) == ("video", "h264", 90_000, 90_000 + 49 * 3600, 50, 3600)
    assert (t["width"], t["height"], t["cc_errors"], t["opens_on_keyframe"], t["has_keyframe"]) == (640, 360, 0, True, True)
    assert containers.parse(build.ts(0, drop=20))["tracks"][0]["cc_errors"] == 1
    assert containers.parse(build.ts(0, key=False))["tracks"][0]["opens_on_keyframe"] is False
    wrapped = containers.parse(build.ts((1 << 33) - 7200))["tracks"][0]
    assert wrapped["min_pts"] == (1 << 33) - 7200 and wrapped["max_pts"] == 47 * 3600


def test_fragments():
    t = containers.parse(build.mp4_fragment(1000), build.mp4_init())["tracks"][0]
    assert (t["width"], t["height"], t["timescale"], t["min_pts"], t["samples"], t["stated_dur"], t["frame_dur"]) == (1280, 720, 12800, 1000, 25, 12800, 512)
    assert t["opens_on_keyframe"] and t["has_keyframe"] and t["protection"] is None
    assert containers.parse(build.mp4_fragment(0, sync=False), build.mp4_init())["tracks"][0]["has_keyframe"] is False
    hidden = containers.parse(build.mp4_fragment(0), build.mp4_init(scheme=b"cbcs"))["tracks"][0]
    assert (hidden["codec"], hidden["protection"]) == ("h264", "cbcs")


def test_packed_audio_and_cues():
    t = containers.parse(build.adts(pts=12345))["tracks"][0]
    assert (t["sample_rate"], t["channels"], t["samples"], t["min_pts"], t["stated_dur"]) == (48000, 2, 10, 12345, 10 * 1024 * 90_000 // 48_000)
    assert containers.parse(build.adts())["tracks"][0]["min_pts"] is None
    v = containers.parse(b"WEBVTT\nX-TIMESTAMP-MAP=LOCAL:00:00:00.000,MPEGTS:900000\n\n00:01.000 --> 00:02.500\nhi\n\n01:00:00.000 --> 01:00:01.000\nx\n")
    assert v["map"] == 900_000 and v["tracks"][0]["samples"] == 2 and v["tracks"][0]["min_pts"] == 1000 and v["tracks"][0]["max_pts"] == 3_601_000


def test_ttml():
    t = containers.parse(b'<tt xmlns="http://www.w3.org/ns/ttml"><p begin="00:00:01.500" end="00:00:02">a</p><p begin="4s" dur="500ms">b</p><p>c</p></tt>')
    assert (t["container"], t["tracks"][0]["samples"], t["tracks"][0]["min_pts"], t["tracks"][0]["max_pts"]) == ("ttml", 2, 1500, 4500)


def index(entries, scale=1000, first=0):
    return build.box(b"sidx", b"\0" * 8, build.struct.pack(">I", scale), build.struct.pack(">II", 0, first), b"\0\0", build.struct.pack(">H", len(entries)), *(build.struct.pack(">III", size | (1 << 31 if deeper else 0), d, 1 << 31) for size, d, deeper in entries))


def test_segment_indexes():
    leaf, top = index([(100, 2000, False), (50, 1000, False)]), index([(0, 0, True)])
    top = index([(len(leaf), 0, True), (70, 500, False)])
    file = top + leaf + bytes(300)
    got = indexes.expand(indexes.sidx(file), lambda at, n: file[at : at + n])
    base = len(top) + len(leaf)
    assert [(e["offset"], e["size"], e["duration"]) for e in got] == [(base, 100, 2000), (base + 100, 50, 1000), (base, 70, 500)]
    assert indexes.sidx(file[:20]) is None and indexes.expand(None, None) == []


def test_splice_sections():
    def made(kind, body, extra=b""):
        w = build.Writer().put(8, 0xFC).put(16, 0).put(8, 0).put(1, 0).put(6, 0).put(33, 90).put(8, 0).put(12, 0).put(12, len(body)).put(8, kind)
        return bytes(int(w.bits[i : i + 8], 2) for i in range(0, len(w.bits), 8)) + body + build.struct.pack(">H", len(extra)) + extra + bytes(4)

    time = build.Writer().put(1, 1).put(6, 63).put(33, (1 << 33) - 10)
    signal = bytes(int(time.bits[i : i + 8], 2) for i in range(0, 40, 8))
    descriptor = b"\2\x14CUEI" + build.struct.pack(">I", 77) + b"\x7f\xbf\x0e\5adId1\x34\0\0"
    s = splices.splice(made(6, signal, descriptor[:1] + bytes([len(descriptor) - 2]) + descriptor[2:]))
    assert (s["command"], s["pts"], s["event_id"], s["upid"], s["segmentation_type"]) == ("time_signal", 80, 77, "adId1", 0x34)
    insert = build.struct.pack(">I", 5) + b"\x7f" + bytes([0b11101111]) + signal + build.struct.pack(">BI", 0xFE, 180_000) + bytes(4)
    s = splices.splice(made(5, insert))
    assert (s["command"], s["pts"], s["event_id"], s["out_of_network"], s["duration"]) == ("splice_insert", 80, 5, True, 180_000)
    assert splices.splice(b"\xfc\0") is None and splices.splice(b"") is None


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.integers(0, 4), st.integers(0, 2000))
def test_damaged_bytes_never_raise(noise, which, cut):
    whole = (build.ts(0, frames=3), build.mp4_fragment(5), build.mp4_init(), build.adts(pts=4), b"WEBVTT\n00:00.000 --> 00:01.000\n")[which]
    containers.parse(noise)
    splices.splice(b"\xfc" + noise)
    indexes.sidx(noise)
    containers.parse(whole[:cut] + noise, whole)
    at = random.Random(cut).randrange(len(whole))
    containers.parse(whole[:at] + noise[:3] + whole[at + 3 :])


def test_rows_to_bytes_and_back(spark):
    rows = [(f"s{i}", bytearray(build.ts(i * 180_000 + i, frames=5, width=320 + 32 * i)), None) for i in range(6)] + [("bad", bytearray(b"<html>"), None), ("none", None, None)]
    m = stage.media(spark.createDataFrame(rows, "uri string, body binary, init binary"))
    t = {r["uri"]: r for r in stage.timeline(stage.tracks(m)).collect()}
    assert {k: r["min_pts"] for k, r in t.items()} == {f"s{i}": i * 180_001 for i in range(6)}
    assert {r["uri"]: r["container"] for r in m.collect()}["bad"] is None
    assert stage.tracks(m).where(F.col("width") == 416).count() == 1
