"""Audio: configurations in MP4 sample entries, and runs of MPEG audio frames."""

from __future__ import annotations

import struct

from mediaprism.media.bits import Bits

# Sampling rates of AAC by index, and channels of AC-3 by coding mode.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
AC3_CHANNELS, AC3_RATES = (2, 1, 2, 3, 3, 4, 4, 5), (48000, 44100, 32000)
# Bit rates (kbit/s) by index, of version 1 and of versions 2 and 2.5, for layers I, II and III; sampling rates by version.
BIT_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def aac_config(data: bytes) -> dict | None:
    """object_type, sample_rate, channels, sbr, ps of an AudioSpecificConfig; implicit band replication is not told."""
    b = Bits(data)
    kind = lambda: 32 + b.take(6) if (k := b.take(5)) == 31 else k
    rate = lambda: b.take(24) if (k := b.take(4)) == 15 else AAC_RATES[k] if k < len(AAC_RATES) else 0
    first, hertz, channels = kind(), rate(), b.take(4)
    if first in (5, 29):
        rate()
    return None if b.short or not hertz else {"object_type": first, "sample_rate": hertz, "channels": {7: 8}.get(channels, channels), "sbr": first in (5, 29), "ps": first == 29}


def es_config(data: bytes) -> dict | None:
    """The configuration inside an ``esds`` box's descriptors."""
    i = 4
    while i + 2 <= len(data):
        tag, i, size = data[i], i + 1, 0
        for _ in range(4):
            if i >= len(data):
                return None
            more, size, i = data[i] & 128, size << 7 | data[i] & 127, i + 1
            if not more:
                break
        if tag == 5:
            return aac_config(data[i : i + size])
        if tag == 3:
            if i + 3 > len(data):
                return None
            # What it depends on, then its address, then its clock's stream.
            flags, i = data[i + 2], i + 3
            i += 2 if flags & 128 else 0
            i += 1 + data[i] if flags & 64 and i < len(data) else 0
            i += 2 if flags & 32 else 0
        else:
            i += 13 if tag == 4 else size
    return None


def box_config(kind: str, data: bytes) -> dict | None:
    """What a configuration box of a sample entry states; None for boxes of other kinds and cut ones."""
    try:
        if kind == "esds":
            return es_config(data)
        if kind == "dOps":
            return {"sample_rate": 48000, "channels": data[1]}
        if kind == "dfLa":
            b = Bits(data[8 + 10 : 8 + 18])
            return {"sample_rate": b.take(20), "channels": b.take(3) + 1} if len(data) >= 26 else None
        if kind in ("dac3", "dec3"):
            b = Bits(data)
            if kind == "dec3":
                b.take(16)
            rate = b.take(2)
            b.take(10 if kind == "dec3" else 8)
            mode, low = b.take(3), b.take(1)
            return None if b.short or rate == 3 else {"sample_rate": AC3_RATES[rate], "channels": AC3_CHANNELS[mode] + low}
    except IndexError:
        return None
    return None


def mpeg_frames(data: bytes) -> dict | None:
    """rate, channels, frames, samples and layer of a run of MPEG audio frames, up to a cut last one.

    None if none begins there. A free-format frame is recognised, but its length is not stated: frames is 0.
    """
    i, frames, samples, out = 0, 0, 0, None
    while i + 4 <= len(data) and data[i] == 0xFF and data[i + 1] & 0xE0 == 0xE0:
        version, layer, index, rate = data[i + 1] >> 3 & 3, 4 - (data[i + 1] >> 1 & 3), data[i + 2] >> 4, data[i + 2] >> 2 & 3
        if version == 1 or layer == 4 or index == 15 or rate == 3:
            break
        hertz = MPEG_RATES[version][rate]
        out = out or {"sample_rate": hertz, "channels": 1 if data[i + 3] >> 6 == 3 else 2, "layer": layer}
        if index == 0:
            break
        bits, padded = BIT_RATES[1 if version == 3 else 2, layer][index] * 1000, data[i + 2] >> 1 & 1
        each = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
        size = (12 * bits // hertz + padded) * 4 if layer == 1 else each // 8 * bits // hertz + padded
        if i + size > len(data):
            break
        frames, samples, i = frames + 1, samples + each, i + size
    return out and out | {"frames": frames, "samples": samples}


def be32(data: bytes, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]
