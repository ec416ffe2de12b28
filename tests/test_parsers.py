"""Parsers of parameter sets, captions, audio and protection on bytes whose truth is known by construction."""

import struct

from media_builder import Writer, box, mp4_fragment, mp4_init, packets, section, stamp

from mediaprism.media import audio, bits, captions, containers, splices


def escaped(raw):
    out = bytearray()
    for b in raw:
        if b <= 3 and out[-2:] == b"\0\0":
            out.append(3)
        out.append(b)
    return bytes(out)


def vui(w, colour):
    """Aspect ratio by numbers, overscan, and a colour description."""
    w.put(1, 1).put(8, 255).put(16, 1).put(16, 1).put(1, 1).put(1, 0).put(1, 1).put(3, 5).put(1, 1)
    return w.put(1, 1).put(8, colour[0]).put(8, colour[1]).put(8, colour[2]) if colour else w.put(1, 0)


def avc(width, height, colour=None, described=True):
    w = Writer().put(8, 100).put(8, 0).put(8, 40).ue(0).ue(1).ue(0).ue(0).put(1, 0).put(1, 0).ue(0).ue(0).ue(0).ue(1).put(1, 0).ue(width // 16 - 1).ue(height // 16 - 1).put(1, 1).put(1, 1).put(1, 0)
    w.put(1, int(described))
    return b"\x67" + escaped((vui(w, colour) if described else w).done())


def hevc(width, height, layers=1, colour=(9, 16, 9), scaling=True):
    w = Writer().put(4, 0).put(3, layers).put(1, 1).put(2, 0).put(1, 1).put(5, 2).put(32, 1 << 29).put(48, 0).put(8, 120)
    for _ in range(layers):
        w.put(2, 3)
    w.put(2 * (8 - layers), 0) if layers else None
    for _ in range(layers):
        w.put(88, 0).put(8, 90)
    w.ue(0).ue(1).ue(width).ue(height + 8).put(1, 1).ue(0).ue(0).ue(0).ue(4).ue(2).ue(2).ue(4).put(1, 1)
    for _ in range(layers + 1):
        w.ue(4).ue(2).ue(0)
    w.ue(0).ue(3).ue(0).ue(3).ue(1).ue(1)
    w.put(1, int(scaling))
    if scaling:
        w.put(1, 1)
        for size in range(4):
            for m in range(0, 6, 3 if size == 3 else 1):
                w.put(1, int(m == 0))
                if m:
                    w.ue(0)
                    continue
                w.ue(3) if size > 1 else None
                for _ in range(min(64, 1 << 4 + 2 * size)):
                    w.ue(0)
    w.put(2, 1).put(1, 1).put(8, 0x77).ue(0).ue(1).put(1, 0)
    w.ue(2).ue(1).ue(1).ue(0).put(1, 1).ue(0).put(1, 1)  # a set of its own with one each way
    w.put(1, 1).put(1, 0).ue(0).put(1, 1).put(1, 0).put(1, 1).put(1, 1)  # one predicted from it
    w.put(1, 1).ue(1).put(8, 5).put(1, 1).put(2, 0).put(1, 1)
    return b"\x42\x01" + escaped(vui(w, colour).done())


def test_parameter_sets_and_colour():
    s = bits.avc_sps(avc(1920, 1088, (1, 1, 1)))
    assert (s.width, s.height, s.profile, s.level) == (1920, 1088, 100, 40) and s.colour == bits.Colour(1, 1, 1, True)
    assert bits.avc_sps(avc(640, 352, None)).colour == bits.Colour(None, None, None, True) and bits.avc_sps(avc(640, 352, described=False)).colour is None
    assert bits.avc_sps(avc(640, 352, (3, 1, 1))).colour is None and bits.avc_sps(avc(640, 352, (1, 99, 1))).colour is None
    for layers in (0, 1, 3):
        for scaling in (True, False):
            h = bits.hevc_sps(hevc(3840, 2160, layers, scaling=scaling))
            assert (h.width, h.height, h.profile, h.level, h.tier) == (3840, 2160, 2, 120, 1) and h.colour == bits.Colour(9, 16, 9, True), (layers, scaling)
    assert bits.hevc_sps(hevc(640, 360)[:12]) is None


def test_keyframes_not_seen_in_cut_bytes_are_unknown():
    unit = lambda n: b"\0\0\1" + bytes([n]) + b"\x88" * 4
    assert bits.keyframes(unit(0x41) + unit(0x65)) == (False, True) and bits.keyframes(unit(0x41)) == (False, False)
    assert bits.keyframes(unit(0x41), whole=False) == (False, None) and bits.keyframes(unit(0x41) * 5000) == (False, False)
    assert bits.keyframes(unit(19 << 1) + unit(1 << 1), "hevc") == (True, True) and bits.keyframes(unit(33 << 1), "hevc") is None


def caption_message(triplets, codec="h264"):
    data = b"\xb5\0\x31GA94\x03" + bytes([0x40 | len(triplets), 0xFF]) + b"".join(bytes(t) for t in triplets)
    body = bytes([4, len(data)]) + data + b"\x80"
    return b"\0\0\1" + (b"\x06" if codec == "h264" else b"\x4e\x01") + escaped(body)


def test_captions():
    packet = [(0xFF, 0xC3, 0x22), (0xFE, 0x41, 0x42), (0xFE, 0x00, 0x00)]
    assert captions.seen(caption_message([(0xFC, 0x94, 0x2C), (0xFD, 0x80, 0x80), *packet]), "h264") == ["SERVICE1", "field1"]
    assert captions.seen(caption_message([(0xFD, 0x94, 0x2C), (0xF8, 0x94, 0x2C)], "hevc"), "hevc") == ["field2"]
    assert captions.services(bytes([3, 0xE1, 0x09, 0x41, 0x00, 0x21])) == {9} and captions.seen(b"\0\0\1\x06\x05\x01\x00\x80", "h264") == []


def test_audio_configurations():
    config = lambda *fields: (lambda w: [w.put(n, v) for n, v in fields] and w.done())(Writer())
    assert audio.aac_config(config((5, 2), (4, 3), (4, 2))) == {"object_type": 2, "sample_rate": 48000, "channels": 2, "sbr": False, "ps": False}
    assert audio.aac_config(config((5, 29), (4, 6), (4, 1), (4, 3), (5, 2)))["ps"] and audio.aac_config(config((5, 31), (6, 10), (4, 15), (24, 44100), (4, 6)))["object_type"] == 42
    asc = config((5, 2), (4, 4), (4, 2))
    es = bytes(4) + b"\x03\x80\x80\x19\0\1\0" + b"\x04\x11" + bytes(13) + b"\x05" + bytes([len(asc)]) + asc
    assert audio.box_config("esds", es)["sample_rate"] == 44100 and audio.box_config("dOps", b"\0\6" + bytes(9)) == {"sample_rate": 48000, "channels": 6}
    assert audio.box_config("dac3", config((2, 1), (5, 8), (3, 0), (3, 7), (1, 1), (5, 0))) == {"sample_rate": 44100, "channels": 6}
    assert audio.box_config("dfLa", bytes(8) + bytes(10) + config((20, 96000), (3, 1), (5, 15)) + bytes(20)) == {"sample_rate": 96000, "channels": 2}
    layer3, layer2 = b"\xff\xfb\x90\x00" + bytes(413), b"\xff\xfd\x80\xc0" + bytes(413)
    assert audio.mpeg_frames(layer3 * 3 + layer3[:50]) == {"sample_rate": 44100, "channels": 2, "layer": 3, "frames": 3, "samples": 3456}
    assert audio.mpeg_frames(b"\xff\xfb\x00\x00")["frames"] == 0 and audio.mpeg_frames(b"text") is None
    t = containers.parse(layer3 * 3)["tracks"][0]
    assert (t["codec"], t["sample_rate"], t["stated_dur"]) == ("mp3", 44100, 3456 * 90000 // 44100) and containers.parse(b"\xff\xfb\x00\x00")["unsupported"]
    assert audio.mpeg_frames(layer2)["layer"] == 2


def splice_insert(event, pts):
    w = Writer().put(8, 0xFC).put(16, 0).put(8, 0).put(1, 0).put(6, 0).put(33, 0).put(20, 0).put(12, 15).put(8, 5)
    w.put(32, event).put(1, 0).put(7, 0).put(1, 1).put(1, 1).put(1, 0).put(1, 0).put(4, 0).put(1, 1).put(6, 0).put(33, pts).put(16, 0).put(16, 0)
    raw = w.done()[:-1]
    return raw[:1] + struct.pack(">H", 0x3000 | len(raw) - 3 + 4) + raw[3:] + bytes(4)


def test_splices_in_streams_and_events():
    table = splice_insert(77, 123456)
    pat, pmt = section(0, b"\0\1\xe1\x00"), section(2, b"\xe1\x01\xf0\x00" + b"\x1b\xe1\x01\xf0\x00" + b"\x86\xe1\x02\xf0\x00")
    pes = b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp(900000) + b"\0\0\1\x65" + b"\x88" * 20
    data = packets(0, pat, 0)[0] + packets(256, pmt, 0)[0] + packets(258, b"\0" + table, 0)[0] + packets(257, pes, 0)[0]
    found = containers.parse_ts(data)["splices"]
    assert [(s["event_id"], s["pts"], s["timescale"], s["out_of_network"]) for s in found] == [(77, 123456, 90000, True)]
    e = bytes(4) + b"urn:scte:scte35:2013:bin\0v\0" + struct.pack(">IIII", 1000, 500, 2000, 9) + table
    assert {k: splices.emsg(e, 64000, 12800)[k] for k in ("id", "pts", "duration")} == {"id": 9, "pts": 64000 + 6400, "duration": 25600}
    one = b"\1\0\0\0" + struct.pack(">IQII", 1000, 7000, 0xFFFFFFFF, 3) + b"urn:x\0\0"
    assert splices.emsg(one, None, 90000)["pts"] == 630000 and splices.emsg(one, None, 90000)["duration"] is None and splices.emsg(b"\0\0", 0, 1) is None
    m = containers.parse_mp4(box(b"emsg", e) + mp4_fragment(64000), mp4_init())
    assert [(s["event_id"], s["pts"]) for s in m["splices"]] == [(77, 123456)]


def test_protection():
    uuid = bytes.fromhex("edef8ba979d64acea3c827dcd51d21ed")
    init = mp4_init(scheme=b"cbcs") + box(b"moov", box(b"pssh", bytes(4), uuid, bytes(4)))
    saiz = box(b"saiz", bytes(4), b"\0", struct.pack(">I", 5), bytes([0, 0, 8, 8, 0]))
    tfhd, tfdt = box(b"tfhd", bytes(4), struct.pack(">I", 1)), box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", 0))
    trun = box(b"trun", b"\0\0\0\0", struct.pack(">I", 5))
    found = containers.parse_mp4(box(b"moof", box(b"traf", tfhd, tfdt, trun, saiz)), init)
    t = found["tracks"][0]
    assert found["drm"] == ["edef8ba9-79d6-4ace-a3c8-27dcd51d21ed"] and (t["protection"], t["clear_samples"], t["encrypted_samples"], t["leading_clear_samples"]) == ("cbcs", 3, 2, 2)
    assert containers.parse_mp4(mp4_fragment(0), mp4_init())["tracks"][0]["encrypted_samples"] is None


def test_one_damaged_container_does_not_hide_another():
    assert containers.parse(box(b"moof", box(b"traf", box(b"tfhd", b"")))) is None
    assert containers.parse(b"WEBVTT\n\n00:00.000 --> 00:01.000\nx")["cues"] == [(0, 1000)]
