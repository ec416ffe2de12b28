"""Media whose truth is known by construction."""

import struct


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, n, v):
        self.bits += f"{v:0{n}b}"
        return self

    def ue(self, v):
        b = f"{v + 1:b}"
        self.bits += "0" * (len(b) - 1) + b
        return self

    def done(self):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def sps(width, height, profile=77, level=31):
    w = Writer().put(8, profile).put(8, 0).put(8, level).ue(0)
    if profile == 100:
        w.ue(1).ue(0).ue(0).put(1, 0).put(1, 0)
    across, down = -(-width // 16), -(-height // 16)
    w.ue(0).ue(2).ue(1).put(1, 0).ue(across - 1).ue(down - 1).put(1, 1).put(1, 1)
    crop = (across * 16 - width, down * 16 - height)
    w.put(1, int(any(crop)))
    if any(crop):
        w.ue(0).ue(crop[0] // 2).ue(0).ue(crop[1] // 2)
    raw = b"\x67" + w.put(1, 0).done()
    return raw.replace(b"\0\0\1", b"\0\0\3\1").replace(b"\0\0\0", b"\0\0\3\0")


def stamp(pts):
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def packets(pid, payload, counter, begins=True):
    out = b""
    while payload or begins:
        room = 184
        part, payload = payload[:room], payload[room:]
        head = bytes([0x47, (64 if begins else 0) | pid >> 8, pid & 255])
        if len(part) < room:
            fill = room - len(part) - 1
            out += head + bytes([0x30 | counter]) + bytes([fill]) + (b"\0" + b"\xff" * (fill - 1) if fill else b"") + part
        else:
            out += head + bytes([0x10 | counter]) + part
        counter, begins = counter + 1 & 15, False
    return out, counter


def section(table, body):
    size = len(body) + 9
    return b"\0" + bytes([table, 0xB0 | size >> 8, size & 255, 0, 1, 0xC1, 0, 0]) + body + b"\0\0\0\0"


def ts(start, frames=50, step=3600, width=640, height=360, drop=None, key=True):
    pat, pmt = section(0, b"\0\1\xe1\x00"), section(2, b"\xe1\x01\xf0\x00" + b"\x1b\xe1\x01\xf0\x00")
    out, counter = packets(0, pat, 0)[0] + packets(256, pmt, 0)[0], 0
    for i in range(frames):
        unit = (b"\0\0\1" + sps(width, height) if i == 0 else b"") + b"\0\0\1" + (b"\x65" if i == 0 and key else b"\x41") + b"\x88" * 300
        pes = b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp((start + i * step) % (1 << 33)) + unit
        made, counter = packets(257, pes, counter)
        out += made if drop != i else made[188:]
    return out


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mp4_init(width=1280, height=720, scale=12800, scheme=None):
    entry = bytes(24) + struct.pack(">HH", width, height) + bytes(50)
    if scheme:
        entry = box(b"encv", entry, box(b"sinf", box(b"frma", b"avc1"), box(b"schm", bytes(4), scheme, bytes(4))))
    else:
        entry = box(b"avc1", entry)
    tkhd, mdhd = box(b"tkhd", bytes(12), struct.pack(">I", 1), bytes(68)), box(b"mdhd", bytes(12), struct.pack(">I", scale), bytes(8))
    trak = box(b"trak", tkhd, box(b"mdia", mdhd, box(b"minf", box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry)))))
    return box(b"ftyp", b"iso6", bytes(4)) + box(b"moov", trak, box(b"mvex", box(b"trex", bytes(4), struct.pack(">5I", 1, 1, 512, 0, 0x10000))))


def mp4_fragment(at, samples=25, sync=True):
    tfhd, tfdt = box(b"tfhd", bytes(4), struct.pack(">I", 1)), box(b"tfdt", b"\1\0\0\0", struct.pack(">Q", at))
    trun = box(b"trun", b"\0\0\0\4", struct.pack(">I", samples), struct.pack(">I", 0x2000000 if sync else 0x10000))
    return box(b"moof", box(b"traf", tfhd, tfdt, trun)) + box(b"mdat", b"x" * 10)


def adts(frames=10, rate_index=3, channels=2, pts=None):
    size = 7 + 20
    frame = bytes([0xFF, 0xF1, 0x40 | rate_index << 2 | channels >> 2, (channels & 3) << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC]) + b"\x11" * 20
    tag = b""
    if pts is not None:
        body = b"com.apple.streaming.transportStreamTimestamp\0" + struct.pack(">Q", pts)
        private = b"PRIV" + bytes([0, 0, 0, len(body), 0, 0]) + body
        tag = b"ID3\4\0\0" + bytes([0, 0, len(private) >> 7, len(private) & 127]) + private
    return tag + frame * frames
