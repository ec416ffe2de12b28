"""Media columns by signature sniffing.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator of each format then
confirms structure and length, so a magic in running text is no finding. The type found at byte
0 corrects the declared one, and what is embedded further on is carved with its place and length.

Cases: null or empty media have no type and nothing carved; truncated or damaged media are not
confirmed; overlapping finds keep the leftmost; of finds at one place the first confirmed stays; what follows a find
is searched on from its end; very long values are walked once by each format, whatever magics they hold (a gzip
stream is unpacked as far as it is one); MPEG audio whose frames do not state their length is not confirmed; repeated
rows give repeated rows; an empty table gives none; of other columns only those named are read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BATCH_BYTES = 8 << 20

# Magic bytes, and how far into the file they stand.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "audio/wav"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ID3", 0, "audio/mpeg"),
    (b"ftyp", 4, "video/mp4"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"%PDF-", 0, "application/pdf"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


class Blob:
    """The bytes of one value, with what the validators find out about them once.

    Walks of one format that come to the same place end alike, so a place that a failed walk has passed is never
    walked from again; ends of documents and archives are searched for once. Both keep sniffing linear
    in the bytes, however many magics they hold.
    """

    def __init__(self, data: bytes):
        self.data, self._passed, self._ends = data, set(), {}

    def again(self, kind: str, at: int) -> bool:
        if (kind, at) in self._passed:
            return True
        self._passed.add((kind, at))
        return False

    def found(self, kind: str, places: list[int]) -> None:
        """A walk that succeeded leaves no trace, so that another may end there too."""
        self._passed.difference_update((kind, i) for i in places)

    def places(self, mark: bytes) -> list[int]:
        if mark not in self._ends:
            self._ends[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._ends[mark]

    def next(self, mark: bytes, at: int) -> int:
        known = self.places(mark)
        i = bisect.bisect_left(known, at)
        return known[i] if i < len(known) else -1


def _walk(x: Blob, kind: str, at: int, step: Callable[[int], int | None], done: Callable[[int], bool]) -> int | None:
    """Steps from place to place until ``done``; None where a step fails or a failed walk has been before."""
    i, seen = at, []
    while i is not None and not x.again(kind, i):
        seen.append(i)
        if done(i):
            x.found(kind, seen)
            return i
        i = step(i)
    return None


def _png(x: Blob, at: int) -> int | None:
    d = x.data

    def step(i: int) -> int | None:
        if i + 12 > len(d):
            return None
        n, kind = struct.unpack_from(">I4s", d, i)
        if i + 12 + n > len(d) or (kind == b"IHDR") != (d[i - 8 : i] == b"\x89PNG\r\n\x1a\n") or zlib.crc32(memoryview(d)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return None
        return i + 12 + n

    end = _walk(x, "png", at + 8, step, lambda i: d[i - 8 : i - 4] == b"IEND")
    return end and end - at


def _gif(x: Blob, at: int) -> int | None:
    d = x.data
    if at + 13 > len(d):
        return None

    def step(i: int) -> int | None:
        if d[i : i + 1] == b"\x21":
            i += 2
        elif d[i : i + 1] == b"\x2c" and i + 10 < len(d):
            i += 11 + (3 << ((d[i + 9] & 7) + 1) if d[i + 9] & 0x80 else 0)
        else:
            return None
        i = _walk(x, "gif block", i, lambda j: j + 1 + d[j] if j < len(d) else None, lambda j: j < len(d) and not d[j])
        return None if i is None else i + 1

    end = _walk(x, "gif", at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 0x80 else 0), step, lambda i: d[i : i + 1] == b"\x3b")
    return end and end + 1 - at


def _jpeg(x: Blob, at: int) -> int | None:
    d, scans = x.data, []

    def step(i: int) -> int | None:
        if i + 4 > len(d) or d[i] != 0xFF or d[i + 1] in (0x00, 0xFF, 0xD9):
            return None
        n, kind = struct.unpack_from(">H", d, i + 2)[0], d[i + 1]
        i += 2 + n
        if n < 2 or kind != 0xDA:
            return None if n < 2 else i
        scans.append(i)
        while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
            i += 2
        return i if i >= 0 else None

    end = _walk(x, "jpeg", at + 2, step, lambda i: bool(scans) and d[i : i + 2] == b"\xff\xd9")
    return end and end + 2 - at


def _wav(x: Blob, at: int) -> int | None:
    d = x.data
    if at + 12 > len(d) or d[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    i, seen = at + 12, set()
    while i + 8 <= end <= len(d):
        kind, n = struct.unpack_from("<4sI", d, i)
        i += 8 + n + (n & 1)
        if i > end or kind == b"data" and b"fmt " not in seen:
            return None
        seen.add(kind)
    return end - at if i == end and {b"fmt ", b"data"} <= seen else None


def _crc(polynomial: int, bits: int) -> list[int]:
    table, top = [], 1 << (bits - 1)
    for n in range(256):
        r = n << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & (1 << bits) - 1
        table.append(r)
    return table


_CRC8, _CRC16 = _crc(0x07, 8), _crc(0x8005, 16)


def _flac_frame(d: bytes, i: int) -> tuple[int, int] | None:
    """Of a frame's header its length and the samples in the frame, if its checksum is right."""
    if i + 6 > len(d) or d[i] != 0xFF or d[i + 1] & 0xFE != 0xF8:
        return None
    block, rate, j = d[i + 2] >> 4, d[i + 2] & 15, i + 4
    j += 1 if d[j] < 0x80 else 8 - (d[j] ^ 0xFF).bit_length()  # the number, as UTF-8 codes one
    samples = {1: 192, 6: int.from_bytes(d[j : j + 1], "big") + 1, 7: int.from_bytes(d[j : j + 2], "big") + 1}.get(block, 576 << block - 2 if 2 <= block <= 5 else 256 << block - 8 if block >= 8 else 0)
    j += {6: 1, 7: 2}.get(block, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for b in d[i:j]:
        check = _CRC8[check ^ b]
    return (j + 1 - i, samples) if j < len(d) and samples and rate != 15 and check == d[j] else None


def _flac(x: Blob, at: int) -> int | None:
    """Metadata, then frame by frame: a frame ends where its checksum comes out and the next one begins, the last one where all samples are there."""
    d, i, last, total = x.data, at + 4, False, 0
    while not last:
        if i + 4 > len(d):
            return None
        last, n = bool(d[i] & 0x80), int.from_bytes(d[i + 1 : i + 4], "big")
        if i == at + 4:
            if n != 34 or d[i] & 0x7F or i + 4 + n > len(d):
                return None
            total = int.from_bytes(d[i + 4 + 13 : i + 4 + 18], "big") & (1 << 36) - 1
        i += 4 + n
    had = 0
    while (head := _flac_frame(d, i)) is not None and not x.again("flac", i):
        had += head[1]
        check, end, beyond = 0, None, min(len(d), i + (1 << 24))  # a frame has its size in 24 bits
        for j in range(i, beyond):
            check = (check << 8 ^ _CRC16[check >> 8 ^ d[j]]) & 0xFFFF
            if not check and j - i >= head[0] and (j + 1 == len(d) or _flac_frame(d, j + 1) or had >= total > 0):
                end = j + 1
                break
        if end is None:
            return None
        i = end
        if had >= total > 0:
            break
    return i - at if had and (not total or had >= total) else None


def _ogg(x: Blob, at: int) -> int | None:
    d = x.data

    def step(i: int) -> int | None:
        if i + 27 > len(d) or d[i : i + 5] != b"OggS\0":
            return None
        n = d[i + 26]
        size = 27 + n + sum(d[i + 27 : i + 27 + n])
        if i + size > len(d):
            return None
        ends.update({i + size} if d[i + 5] & 4 else ())
        return i + size

    ends: set[int] = set()
    end = _walk(x, "ogg", at, step, lambda i: i in ends)
    return end and end - at


# Bit rates (kbit/s) by index, for version 1 and versions 2 and 2.5 of layers I, II and III; sampling rates by version.
BIT_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
AUDIO_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mpeg_frame(d: bytes, i: int) -> int | None:
    """The length of the MPEG audio frame that begins there; None if none does or its length is not stated."""
    if i + 4 > len(d) or d[i] != 0xFF or d[i + 1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = d[i + 1] >> 3 & 3, 4 - (d[i + 1] >> 1 & 3), d[i + 2] >> 4, d[i + 2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    bits, hertz, padded_by = BIT_RATES[1 if version == 3 else 2, layer][index] * 1000, AUDIO_RATES[version][rate], d[i + 2] >> 1 & 1
    return (12 * bits // hertz + padded_by) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * bits // hertz + padded_by


def _mp3(x: Blob, at: int) -> int | None:
    """An ID3 tag and the frames after it, up to the last whole one."""
    d = x.data
    if at + 10 > len(d) or d[at + 3] not in (2, 3, 4) or any(b & 0x80 for b in d[at + 6 : at + 10]):
        return None
    i = first = at + 10 + functools.reduce(lambda n, b: n << 7 | b, d[at + 6 : at + 10], 0)
    while (n := _mpeg_frame(d, i)) is not None and i + n <= len(d):
        i += n
    return i - at if i > first else None


def _mp4(x: Blob, at: int) -> int | None:
    d, i, boxes = x.data, at, 0
    while 0 <= i and i + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, i)
        if n < 8 or i + n > len(d) or not all(32 <= b < 127 for b in kind) or boxes and x.again("mp4", i):
            break
        i, boxes = i + n, boxes + 1
    return i - at if at >= 0 and boxes > 1 else None


def _zip(x: Blob, at: int) -> int | None:
    """Up to the end record whose directory lies where it says, counted from this entry."""
    d = x.data
    if "zip" not in x._ends:
        x._ends["zip"] = {}
        for end in x.places(b"PK\x05\x06"):
            if end + 22 <= len(d):
                size, start, note = struct.unpack_from("<IIH", d, end + 12)
                x._ends["zip"].setdefault(end - size - start, (end + 22 + note, start))
    found = x._ends["zip"].get(at)
    return found[0] - at if found and found[0] <= len(d) and d[at + found[1] : at + found[1] + 4] == b"PK\x01\x02" else None


def _pdf(x: Blob, at: int) -> int | None:
    start = x.next(b"startxref", at)
    end = x.next(b"%%EOF", start) if start >= 0 else -1
    # A stretch with an end but without the other belongs to no document.
    return end + 5 - at if end >= 0 and x.next(b"%%EOF", at) == end else None


def _gzip(x: Blob, at: int) -> int | None:
    z = zlib.decompressobj(31)
    try:
        for i in range(at, len(x.data), 1 << 16):
            z.decompress(x.data[i : i + (1 << 16)])
            if z.eof:
                return min(len(x.data), i + (1 << 16)) - len(z.unused_data) - at
    except zlib.error:
        pass
    return None


CHECKS: dict[str, Callable[[Blob, int], int | None]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "audio/flac": _flac, "audio/ogg": _ogg,
    "audio/mpeg": _mp3, "video/mp4": _mp4, "application/zip": _zip, "application/pdf": _pdf, "application/gzip": _gzip,
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Over bytes read as Latin-1, one character a byte."""
    a = ahocorasick.Automaton()
    for magic, before, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), before, kind))
    a.make_automaton()
    return a


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """Confirmed media as (type, offset, length), the outer one before what it holds.

    Inside a confirmed container the search goes on; there, finds do not overlap each other.
    """
    if not data:
        return []
    found: list[tuple[str, int, int]] = []
    free, x = 0, Blob(data)
    for last, (size, before, kind) in automaton().iter(data.decode("latin-1")):
        at = last - size + 1 - before
        if at < free or at < 0 or found and found[-1][1] == at:
            continue
        if (n := CHECKS[kind](x, at)) is not None:
            found.append((kind, at, n))
            free = at + n if at else 0
    return found


def store_as_wav(payload: bytes, rate: int = 16_000) -> bytes:
    """8-bit samples, one channel; the payload's length is even."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_samples(data: bytes) -> bytes:
    i = 12
    while i + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    return b""


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def _in_parts(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= _BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def text_to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column from texts: id, n_bytes (of the text), declared (what the source claims), media (WAV bytes)."""
    field = docs.select(F.col(id_col).alias("id"))
    id_kind = field.schema["id"].dataType

    def store(batches):
        for b in batches:
            kinds = [b.column(0).type, pa.int64(), pa.string(), pa.binary()]
            raw = ((i.as_py(), (t.as_py() or "").encode()) for i, t in zip(b.column(0), b.column(1), strict=True))
            yield from _in_parts(((i, len(x), "text/plain", store_as_wav(padded(x))) for i, x in raw), ["id", "n_bytes", "declared", "media"], kinds, lambda r: len(r[3]))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(store, f"id {id_kind.simpleString()}, n_bytes long, declared string, media binary")


def sniff_media(media: DataFrame, *, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ("id", "n_bytes")) -> DataFrame:
    """The kept columns, declared, detected, corrected (they differ), carved (type, offset, length), media digests and, of 8-bit samples, the payload's."""
    rows = media.select(*keep, F.col(declared_col).alias("declared"), F.col(media_col).alias("media"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[: len(keep)]), "declared string, detected string, corrected boolean, carved array<struct<type:string,offset:bigint,length:bigint>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"])
    carved_kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def read(batches):
        for b in batches:
            out = []
            for declared, value in zip(b.column(len(keep)), b.column(len(keep) + 1), strict=True):
                data = value.as_py() or b""
                found = sniff(data)
                detected = found[0][0] if found and found[0][1] == 0 else None
                carved = [{"type": t, "offset": o, "length": n} for t, o, n in found if o > 0]
                payload = wav_samples(data) if detected == "audio/wav" else data
                out.append((declared.as_py(), detected, detected is not None and detected != declared.as_py(), carved, len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature(payload)))
            kinds = [pa.string(), pa.string(), pa.bool_(), carved_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = ["declared", "detected", "corrected", "carved", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True))], [*keep, *names])

    return rows.mapInArrow(read, schema)


def feature(payload: bytes) -> str:
    """Of unsigned 8-bit samples: their number, peak, sum, sum of squares and zero crossings, all whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "n=0"
    return f"n={len(x)} peak={int(np.abs(x).max())} sum={int(x.sum())} squares={int(x @ x)} crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"
