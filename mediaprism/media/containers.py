"""Readers of MPEG transport streams, packed AAC, fragmented MP4, WebVTT and TTML.

Each gives plain dictionaries; what the bytes do not say is None. Damaged input never raises: it
gives None, which callers record as a parse error.
"""

from __future__ import annotations

import re
import struct
from statistics import median_high

from mediaprism.media.audio import box_config, mpeg_frames
from mediaprism.media.bits import VideoShape, keyframes, shape_of
from mediaprism.media import samples
from mediaprism.media.captions import seen
from mediaprism.media.splices import emsg, splice

CLOCK = 90_000
TURN = 1 << 33

# Stream types of transport streams, and sampling rates of ADTS.
STREAM_TYPES = {0x0F: ("audio", "aac"), 0x03: ("audio", "mp2"), 0x04: ("audio", "mp2"), 0x1B: ("video", "h264"), 0x24: ("video", "hevc"), 0x81: ("audio", "ac3"), 0x86: ("other", "scte35"), 0xDB: ("video", "h264"), 0xCF: ("audio", "aac"), 0xC1: ("audio", "ac3"), 0xC2: ("audio", "ec3")}
#: Of these the types that say that samples are encrypted.
SEALED_TYPES = frozenset((0xDB, 0xCF, 0xC1, 0xC2))
RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


MORE = ("profile", "level", "tier", "constraints", "primaries", "transfer", "matrix", "full_range", "object_type", "sbr", "ps", "captions", "clear_samples", "encrypted_samples", "leading_clear_samples", "crypt_pattern")


def _shaped(t: dict, s: VideoShape | None) -> None:
    if s:
        t |= {"width": s.width, "height": s.height, "profile": s.profile, "level": s.level, "tier": s.tier, "constraints": s.constraints}
        if s.colour:
            t |= {"primaries": s.colour.primaries, "transfer": s.colour.transfer, "matrix": s.colour.matrix, "full_range": s.colour.full_range}


def track(kind: str, codec: str, **more) -> dict:
    return dict.fromkeys(("timescale", "min_pts", "max_pts", "samples", "stated_dur", "frame_dur", "width", "height", "sample_rate", "channels", "cc_errors", "opens_on_keyframe", "has_keyframe", "protection", *MORE)) | {"kind": kind, "codec": codec} | more


def _clock(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def parse_ts(data: bytes) -> dict | None:
    """Programs, clocks, continuity and elementary streams of a transport stream, by PID."""
    start = next((i for i in range(min(188, len(data))) if data[i : i + 1] == b"\x47" and data[i + 188 : i + 189] in (b"\x47", b"")), None)
    if start is None or len(data) - start < 188:
        return None
    pmts: set[int] = set()
    streams: dict[int, tuple[str, str]] = {}
    clocks: dict[int, list[int]] = {}
    bodies: dict[int, bytearray] = {}
    counters: dict[int, int] = {}
    errors: dict[int, int] = {}
    sections: dict[int, bytearray] = {}
    sealed: set[int] = set()
    told: list[dict] = []

    def table(pid: int, s: bytes) -> None:
        """A whole section: programs, streams or a splice."""
        size = len(s) - 4
        if pid == 0 and s[0] == 0:
            pmts.update((s[k + 2] & 31) << 8 | s[k + 3] for k in range(8, size - 3, 4) if s[k] or s[k + 1])
        elif pid in pmts and s[0] == 2:
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= size:
                streams[(s[k + 1] & 31) << 8 | s[k + 2]] = STREAM_TYPES.get(s[k], ("other", f"0x{s[k]:02x}"))
                sealed.update(((s[k + 1] & 31) << 8 | s[k + 2],) if s[k] in SEALED_TYPES else ())
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
        elif s[0] == 0xFC and (found := splice(s)):
            told.append(found | {"timescale": CLOCK})

    for i in range(start, len(data) - 187, 188):
        p = data[i : i + 188]
        if p[0] != 0x47:
            continue
        pid, begins, control, counter = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] >> 4 & 3, p[3] & 15
        body = p[4:]
        jump = False
        if control & 2:
            jump = len(body) > 1 and body[0] > 0 and bool(body[1] & 128)
            body = body[1 + body[0] :]
        if not control & 1:
            continue
        if pid in counters and not jump and pid in streams and counter not in (counters[pid], counters[pid] + 1 & 15):
            errors[pid] = errors.get(pid, 0) + 1
        again = pid in counters and counter == counters[pid] and not jump
        counters[pid] = counter
        if again:
            continue
        if pid == 0 or pid in pmts or streams.get(pid, ("", ""))[1] == "scte35":
            # A section may span packets: what a pointer says belongs to the one before completes it.
            held = sections.setdefault(pid, bytearray())
            if begins and body:
                held += body[1 : 1 + body[0]]
            elif held:
                held += body
            for last in (False, True):
                if len(held) >= 3 and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
                    table(pid, bytes(held[:size]))
                    held.clear()
                if begins and body and not last:
                    held[:] = body[1 + body[0] :]
                if not begins:
                    break
        elif pid in streams:
            if begins and body[:3] == b"\0\0\1" and len(body) > 14:
                if body[7] & 128:
                    clocks.setdefault(pid, []).append(_clock(body[9:14]))
                body = body[9 + body[8] :]
            held = bodies.setdefault(pid, bytearray())
            held += body
    tracks = []
    for pid in sorted(streams):
        kind, codec = streams[pid]
        pts = clocks.get(pid, [])
        if pts and max(pts) - min(pts) > TURN // 2:  # the clock turned over inside the segment
            pts = [x if x > TURN // 2 else x + TURN for x in pts]
        steps = [b - a for a, b in zip(sorted(pts), sorted(pts)[1:], strict=False) if b > a]
        t = track(kind, codec, timescale=CLOCK, samples=len(pts), cc_errors=errors.get(pid, 0))
        if pts:
            t |= {"min_pts": min(pts) % TURN, "max_pts": max(pts) % TURN, "frame_dur": median_high(steps) if steps else None}
        body = bytes(bodies.get(pid, b""))
        if pid in sealed:
            tracks.append(t | {"protection": "sample-aes"})  # the clock is open, what the samples say is not
            continue
        if codec in ("h264", "hevc"):
            _shaped(t, shape_of(body, codec))
            if (k := keyframes(body, codec)) is not None:
                t |= {"opens_on_keyframe": k[0], "has_keyframe": k[1], "captions": seen(body, codec)}
        elif codec == "aac" and (a := adts(body)):
            t |= {"sample_rate": a[0], "channels": a[1]}
        elif codec == "mp2" and (m := mpeg_frames(body)):
            t |= {"codec": f"mp{m['layer']}", "sample_rate": m["sample_rate"], "channels": m["channels"]}
        tracks.append(t)
    return {"container": "ts", "tracks": tracks, "splices": told, "sealed": bool(sealed)} if tracks else None


def adts(data: bytes) -> tuple[int, int, int, int] | None:
    """Rate, channels, frames and samples of a run of ADTS frames, up to a truncated last one."""
    i, frames, samples, first = 0, 0, 0, None
    while i + 7 <= len(data) and data[i] == 0xFF and data[i + 1] & 0xF6 == 0xF0:
        size = (data[i + 3] & 3) << 11 | data[i + 4] << 3 | data[i + 5] >> 5
        rate = data[i + 2] >> 2 & 15
        if rate >= len(RATES) or size < 7:
            return None
        first = first or (RATES[rate], (data[i + 2] & 1) << 2 | data[i + 3] >> 6)
        if i + size > len(data):
            break
        frames, samples, i = frames + 1, samples + 1024 * ((data[i + 6] & 3) + 1), i + size
    return (*first, frames, samples) if first and frames else None


def parse_packed_audio(data: bytes) -> dict | None:
    """ADTS, after an ID3 tag whose private frame may state a 33-bit clock."""
    pts, i = None, 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    if data[:3] == b"ID3" and len(data) >= 10:
        end, i = 10 + safe(data[6:10]), 10
        while i + 10 <= min(end, len(data)) and data[i]:
            size = safe(data[i + 4 : i + 8]) if data[3] >= 4 else int.from_bytes(data[i + 4 : i + 8], "big")
            owner, _, value = data[i + 10 : i + 10 + size].partition(b"\0")
            if data[i : i + 4] == b"PRIV" and owner == b"com.apple.streaming.transportStreamTimestamp" and len(value) >= 8:
                pts = int.from_bytes(value[:8], "big") % TURN
            i += 10 + size
        i = end
    if not (a := adts(data[i:])):
        if not (m := mpeg_frames(data[i:])):
            return None
        if not m["frames"]:
            return {"container": "packed", "tracks": [], "unsupported": True}
        length = m["samples"] * CLOCK // m["sample_rate"]
        return {"container": "packed", "tracks": [track("audio", f"mp{m['layer']}", timescale=CLOCK, min_pts=pts, max_pts=pts, samples=m["frames"], stated_dur=length, frame_dur=length // m["frames"], sample_rate=m["sample_rate"], channels=m["channels"])]}
    length = a[3] * CLOCK // a[0]
    return {"container": "packed", "tracks": [track("audio", "aac", timescale=CLOCK, min_pts=pts, max_pts=pts, samples=a[2], stated_dur=length, frame_dur=length // a[2], sample_rate=a[0], channels=a[1])]}


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """Type, start and end of the payload of each box."""
    i, end = start, len(data) if end is None else end
    while i + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, i)
        head = 8
        if size == 1 and i + 16 <= end:
            size, head = struct.unpack_from(">Q", data, i + 8)[0], 16
        size = end - i if size == 0 else size
        if size < head or i + size > end:
            return
        yield kind.decode("latin-1"), i + head, i + size
        i += size


def _inside(data: bytes, path: str, start: int, end: int):
    name, _, rest = path.partition("/")
    for kind, a, b in boxes(data, start, end):
        if kind == name:
            yield from _inside(data, rest, a, b) if rest else ((a, b),)


# Sample entries and the track kind and codec each names.
ENTRIES = {"avc1": ("video", "h264"), "avc3": ("video", "h264"), "hvc1": ("video", "hevc"), "hev1": ("video", "hevc"), "av01": ("video", "av1"), "vp09": ("video", "vp9"), "mp4a": ("audio", "aac"), "ac-3": ("audio", "ac3"), "ec-3": ("audio", "eac3"), "Opus": ("audio", "opus"), "wvtt": ("text", "wvtt"), "stpp": ("text", "stpp"), "c608": ("captions", "c608"), "c708": ("captions", "c708"), "encv": ("video", None), "enca": ("audio", None)}


def _tracks_of(data: bytes) -> dict[int, dict]:
    found = {}
    for a, b in _inside(data, "moov/trak", 0, len(data)):
        version, scale = None, None
        number = None
        for x, _ in _inside(data, "tkhd", a, b):
            version = data[x]
            number = struct.unpack_from(">I", data, x + (20 if version else 12))[0]
        for x, _ in _inside(data, "mdia/mdhd", a, b):
            scale = struct.unpack_from(">I", data, x + (20 if data[x] else 12))[0]
        for x, y in _inside(data, "mdia/minf/stbl/stsd", a, b):
            for kind, s, e in boxes(data, x + 8, y):
                what = ENTRIES.get(kind, ("other", kind))
                t = track(*what, timescale=scale)
                inner = s + (78 if what[0] == "video" else 28)
                if what[0] == "video" and e - s >= 28:
                    t["width"], t["height"] = struct.unpack_from(">HH", data, s + 24)
                elif what[0] == "audio" and e - s >= 28:
                    t["channels"], t["sample_rate"] = struct.unpack_from(">H", data, s + 16)[0], struct.unpack_from(">I", data, s + 24)[0] >> 16
                for p, _ in _inside(data, "sinf/frma", inner, e):
                    t["kind"], t["codec"] = ENTRIES.get(data[p : p + 4].decode("latin-1"), (t["kind"], None))
                for p, _ in _inside(data, "sinf/schm", inner, e):
                    t["protection"] = data[p + 4 : p + 8].decode("latin-1")
                for p, q in _inside(data, "sinf/schi/tenc", inner, e):
                    if q - p >= 8:
                        t["crypt_pattern"] = data[p] > 0 and data[p + 5] != 0
                        t["_guard"] = (data[p + 6], data[p + 7])
                for box, p, q in boxes(data, inner, e):
                    if t["kind"] == "audio" and (c := box_config(box, data[p:q])):
                        t |= c
                    elif box == "avcC" and q - p >= 4:
                        t |= {"profile": data[p + 1], "constraints": data[p + 2], "level": data[p + 3], "_width": (data[p + 4] & 3) + 1 if q - p > 4 else 4}
                    elif box == "hvcC" and q - p >= 13:
                        t |= {"profile": data[p + 1] & 31, "tier": data[p + 1] >> 5 & 1, "level": data[p + 12], "_width": (data[p + 21] & 3) + 1 if q - p > 21 else 4}
                    elif box == "av1C" and q - p >= 3:
                        t |= {"profile": data[p + 1] >> 5, "level": data[p + 1] & 31, "tier": data[p + 2] >> 7}
                    elif box == "vpcC" and q - p >= 6:
                        t |= {"profile": data[p + 4], "level": data[p + 5]}
                    if box == "colr" and q - p >= 11 and data[p : p + 4] == b"nclx":
                        t |= dict(zip(("primaries", "transfer", "matrix"), struct.unpack_from(">HHH", data, p + 4), strict=True)) | {"full_range": bool(data[p + 10] >> 7)}
                found[number] = t
                break
    for x, _ in _inside(data, "moov/mvex/trex", 0, len(data)):
        number, _, length, size, flags = struct.unpack_from(">5I", data, x + 4)
        if number in found:
            found[number]["_default"] = (length, flags, size)
    return found


def _uuid(raw: bytes) -> str:
    x = raw.hex()
    return "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))


def _guarded(t: dict, data: bytes, a: int, b: int, n: int) -> None:
    """How many samples of a fragment are clear and encrypted, by the sizes of their auxiliary information."""
    if not t["protection"] or not n:
        return
    sizes: list[int] | None = None
    for x, y in _inside(data, "saiz", a, b):
        i = x + 4 + (8 if data[x + 3] & 1 else 0)
        count = struct.unpack_from(">I", data, i + 1)[0]
        sizes = [data[i]] * min(count, n) if data[i] else list(data[i + 5 : min(y, i + 5 + count)])
    held = any(True for _ in _inside(data, "senc", a, b))
    if sizes is None:
        sizes = [1] * n if held or t.get("_guard", (1, 8))[0] and t.get("_guard", (1, 8))[1] == 0 else [0] * n
    sizes = (sizes + [0] * n)[:n]
    enc = sum(1 for s in sizes if s)
    lead = next((k for k, s in enumerate(sizes) if s), n)
    if not t["encrypted_samples"]:
        t["leading_clear_samples"] = (t["leading_clear_samples"] or 0) + lead
    t["encrypted_samples"], t["clear_samples"] = (t["encrypted_samples"] or 0) + enc, (t["clear_samples"] or 0) + n - enc


def _fragments(data: bytes):
    """Of each track in each movie fragment: the fragment's first byte, the track's span, and whether it is the fragment's first."""
    i = 0
    for kind, a, b in boxes(data):
        if kind == "moof":
            for nth, (x, y) in enumerate(_inside(data, "traf", a, b)):
                yield i, x, y, nth == 0
        i = b


def _read_samples(t: dict, data: bytes, places: list[samples.Sample]) -> list[tuple[int, int]]:
    """Reads what a track's samples say into it, and gives the cues of a text track in milliseconds. Encrypted samples say nothing."""
    if t["protection"]:
        return []
    held = [(p, data[p.offset : p.offset + p.size]) for p in places if p.size and 0 <= p.offset and p.offset + p.size <= len(data)]
    if not held:
        return []
    bodies = [body for _, body in held]
    scale = t["timescale"] or 1000
    ms = lambda ticks: round(ticks * 1000 / scale)
    if t["kind"] == "video" and t["codec"] in ("h264", "hevc"):
        width = t.get("_width", 4)
        t["captions"] = samples.video_captions(bodies, t["codec"], width)
        opens = samples.pictures(bodies[0], t["codec"], width)
        if opens:  # the pictures themselves speak before the flags
            t["opens_on_keyframe"] = opens[0]
            t["has_keyframe"] = any(any(samples.pictures(body, t["codec"], width)) for body in bodies)
    elif t["kind"] == "captions":
        t["captions"] = samples.track_captions(bodies, t["codec"])
    elif t["codec"] == "wvtt":
        return [(ms(p.at), ms(p.at + p.lasts)) for p, body in held if samples.is_cue(body)]
    elif t["codec"] == "stpp":
        return [c for body in bodies for c in (parse_ttml(body) or {"cues": []})["cues"]]
    return []


def parse_mp4(data: bytes, init: bytes | None = None) -> dict | None:
    """Tracks of a fragment, described by its init segment or its own moov."""
    if not any(k in ("ftyp", "styp", "moof", "moov", "sidx") for k, _, _ in boxes(data)):
        return None
    tracks = _tracks_of(init or b"") | _tracks_of(data)
    places: dict[int, list[samples.Sample]] = {}
    last_end = 0
    for moof, a, b, first_of_moof in _fragments(data):
        last_end = moof if first_of_moof else last_end
        for x, _ in _inside(data, "tfhd", a, b):
            flags, number = int.from_bytes(data[x + 1 : x + 4], "big"), struct.unpack_from(">I", data, x + 4)[0]
            i = x + 8 + (8 if flags & 1 else 0) + (4 if flags & 2 else 0)
            t = tracks.setdefault(number, track("other", None))
            length, sample_flags, size = t.get("_default", (0, 0, 0))
            # Without a stated base: the fragment itself, or for later tracks of an old form where the data before ends.
            base = struct.unpack_from(">Q", data, x + 8)[0] if flags & 1 else moof if flags & 0x20000 else last_end
            if flags & 8:
                length, i = struct.unpack_from(">I", data, i)[0], i + 4
            if flags & 16:
                size, i = struct.unpack_from(">I", data, i)[0], i + 4
            if flags & 32:
                sample_flags = struct.unpack_from(">I", data, i)[0]
        had = t["samples"] or 0
        at, end = 0, base
        for x, _ in _inside(data, "tfdt", a, b):
            at = struct.unpack_from(">Q" if data[x] else ">I", data, x + 4)[0]
        for x, y in _inside(data, "trun", a, b):
            flags, n = int.from_bytes(data[x + 1 : x + 4], "big"), struct.unpack_from(">I", data, x + 4)[0]
            i = x + 8 + (4 if flags & 1 else 0)
            end = base + struct.unpack_from(">i", data, x + 8)[0] if flags & 1 else end
            first = None
            if flags & 4:
                first, i = struct.unpack_from(">I", data, i)[0], i + 4
            each = sum(4 for bit in (256, 512, 1024, 2048) if flags & bit)
            if n * each > y - i or not each and n > (1 << 24):
                return None
            for k in range(n):
                step, own, shift, room = length, first if k == 0 and first is not None else sample_flags, 0, size
                if flags & 256:
                    step, i = struct.unpack_from(">I", data, i)[0], i + 4
                if flags & 512:
                    room, i = struct.unpack_from(">I", data, i)[0], i + 4
                if flags & 1024:
                    own, i = struct.unpack_from(">I", data, i)[0], i + 4
                if flags & 2048:
                    shift, i = struct.unpack_from(">i" if data[x] else ">I", data, i)[0], i + 4
                shown = at + shift
                places.setdefault(number, []).append(samples.Sample(end, room, shown, step))
                end += room
                sync = not own & 0x10000
                t["min_pts"] = shown if t["min_pts"] is None else min(t["min_pts"], shown)
                t["max_pts"] = shown if t["max_pts"] is None else max(t["max_pts"], shown)
                if t["kind"] == "video":
                    t["opens_on_keyframe"] = sync if t["opens_on_keyframe"] is None else t["opens_on_keyframe"]
                    t["has_keyframe"] = bool(t["has_keyframe"]) or sync
                t["samples"], t["stated_dur"], at = (t["samples"] or 0) + 1, (t["stated_dur"] or 0) + step, at + step
        last_end = end
        _guarded(t, data, a, b, (t["samples"] or 0) - had)
    cues = [c for number in sorted(places) for c in _read_samples(tracks[number], data, places[number])]
    starts = {k: t["min_pts"] for k, t in tracks.items()}
    told = []
    first = next((k for k in tracks if starts[k] is not None), None)
    for kind, a, b in boxes(data):
        if kind == "emsg" and first is not None and (m := emsg(data[a:b], starts[first], tracks[first]["timescale"] or 1)) and m["splice"]:
            told.append(m["splice"] | {"pts": m["pts"] if m["splice"]["pts"] is None else m["splice"]["pts"], "timescale": tracks[first]["timescale"] if m["splice"]["pts"] is None else CLOCK})
    for t in tracks.values():
        t.pop("_default", None), t.pop("_guard", None), t.pop("_width", None)
        if t["samples"]:
            t["frame_dur"] = t["stated_dur"] // t["samples"] or None
    guards = [_uuid(d[a + 4 : a + 20]) for d in (init or b"", data) for at in ("moov/pssh", "moof/pssh") for a, b in _inside(d, at, 0, len(d)) if b - a >= 20]
    return {"container": "mp4", "drm": sorted(set(guards)), "splices": told, "cues": cues, "tracks": [tracks[k] for k in sorted(tracks, key=lambda k: k or 0)]}


_CUE = re.compile(r"((?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s+-->\s+((?:\d+:)?\d{2}:\d{2}[.,]\d{3})")


def _ms(stamp: str) -> int:
    *whole, last = stamp.replace(",", ".").split(":")
    seconds = 0
    for x in whole:
        seconds = seconds * 60 + int(x)
    return seconds * 60_000 + round(float(last) * 1000)


def parse_webvtt(data: bytes) -> dict | None:
    """Cues in milliseconds, and the media clock that a timestamp map states."""
    text = data.decode("utf-8-sig", "replace")
    if not text.startswith("WEBVTT"):
        return None
    cues = [(_ms(a), _ms(b)) for a, b in _CUE.findall(text)]
    clock = re.search(r"X-TIMESTAMP-MAP=.*MPEGTS:(\d+)", text)
    t = track("text", "wvtt", timescale=1000, samples=len(cues), min_pts=min((a for a, _ in cues), default=None), max_pts=max((b for _, b in cues), default=None))
    return {"container": "webvtt", "tracks": [t], "cues": cues, "map": int(clock[1]) if clock else None}


_PARAGRAPH = re.compile(r"<(?:\w+:)?p\b([^>]*)>")
_OFFSET = re.compile(r"^([0-9.]+)(h|m|s|ms|f|t)$")


def _ttml_ms(value: str, frames: float, ticks: float) -> int | None:
    if m := _OFFSET.match(value):
        unit = {"h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1, "f": 1000 / frames, "t": 1000 / ticks}[m[2]]
        return round(float(m[1]) * unit)
    if m := re.match(r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)(?::(\d+))?$", value):
        return round((int(m[1]) * 3600 + int(m[2]) * 60 + float(m[3]) + int(m[4] or 0) / frames) * 1000)
    return None


def parse_ttml(data: bytes) -> dict | None:
    """Paragraphs with a begin, in milliseconds; a duration stands in for an end."""
    text = data.decode("utf-8", "replace")
    if not re.search(r"<(?:\w+:)?tt[\s>]", text[:4096]):
        return None
    number = lambda name, other: float(m[1]) if (m := re.search(rf'{name}="([0-9.]+)"', text)) and float(m[1]) > 0 else other
    frames, ticks = number("frameRate", 30.0), number("tickRate", 1.0)
    cues = []
    for attributes in _PARAGRAPH.findall(text):
        found = dict(re.findall(r'\b(begin|end|dur)="([^"]*)"', attributes))
        begin = _ttml_ms(found.get("begin", ""), frames, ticks)
        end, length = _ttml_ms(found.get("end", ""), frames, ticks), _ttml_ms(found.get("dur", ""), frames, ticks)
        if begin is not None:
            cues.append((begin, end if end is not None else begin + (length or 0)))
    return {"container": "ttml", "cues": cues, "tracks": [track("text", "stpp", timescale=1000, samples=len(cues), min_pts=min((a for a, _ in cues), default=None), max_pts=max((b for _, b in cues), default=None))]}


def parse(data: bytes, init: bytes | None = None) -> dict | None:
    """The first container that recognises the bytes: MP4, transport stream, packed audio, WebVTT, TTML."""
    for read in (lambda: parse_mp4(data, init), lambda: parse_ts(data), lambda: parse_packed_audio(data), lambda: parse_webvtt(data), lambda: parse_ttml(data)):
        try:
            if (found := read()) is not None:
                return found
        except (struct.error, IndexError, ValueError, UnboundLocalError):
            continue  # damaged as this container; another may still know it
    return None
