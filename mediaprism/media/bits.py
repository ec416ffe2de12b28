"""A bit reader with Exp-Golomb codes, and parameter sets of AVC video."""

from __future__ import annotations

from dataclasses import dataclass


class Bits:
    """Reads past the end give 0 and set ``short``, which callers look at once, at the end."""

    def __init__(self, data: bytes):
        self.value, self.left, self.short = int.from_bytes(data, "big"), len(data) * 8, False

    def take(self, n: int) -> int:
        if n > self.left:
            self.short, self.left = True, 0
            return 0
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
            if zeros > 32 or self.short:
                self.short = True
                return 0
        return (1 << zeros) - 1 + self.take(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def without_emulation(nal: bytes) -> bytes:
    """The 03 after two zero bytes goes."""
    return nal.replace(b"\0\0\3", b"\0\0")


def nal_units(data: bytes, most: int = 1 << 62) -> list[bytes]:
    """Units between Annex B start codes, ``most`` of them where only the first matter."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0 and len(out) < most:
        after = data.find(b"\0\0\1", at + 3)
        out.append(data[at + 3 : after if after >= 0 else len(data)].rstrip(b"\0") if after >= 0 else data[at + 3 :])
        at = after
    return out


@dataclass(frozen=True)
class VideoShape:
    width: int
    height: int
    profile: int
    level: int
    tier: int | None = None
    constraints: int | None = None
    colour: Colour | None = None


@dataclass(frozen=True)
class Colour:
    """Code points as a parameter set states them; the range may be stated without them."""

    primaries: int | None
    transfer: int | None
    matrix: int | None
    full_range: bool | None


def _colour(b: Bits) -> Colour | None:
    """The part of video usability information that begins it, which both kinds of sets share; None where it says nothing or is a misread."""
    if b.take(1) and b.take(8) == 255:
        b.take(32)
    if b.take(1):
        b.take(1)
    if not b.take(1):
        return None
    b.take(3)
    full, described = bool(b.take(1)), b.take(1)
    if not described:
        return None if b.short else Colour(None, None, None, full)
    primaries, transfer, matrix = b.take(8), b.take(8), b.take(8)
    if b.short or primaries in (0, 3) or transfer in (0, 3) or matrix == 3 or primaries > 22 or transfer > 18 or matrix > 14:
        return None
    return Colour(primaries, transfer, matrix, full)


# AVC profiles whose parameter sets carry a chroma format and scaling lists.
HIGH_PROFILES = (44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244)


def avc_sps(nal: bytes) -> VideoShape | None:
    """Coded size less the cropping, profile and level; None if the set is truncated or implausible."""
    b = Bits(without_emulation(nal[1:]))
    profile, constraints, level = b.take(8), b.take(8), b.take(8)
    b.ue()
    chroma, separate = 1, 0
    if profile in HIGH_PROFILES:
        chroma = b.ue()
        if chroma == 3:
            separate = b.take(1)
        b.ue(), b.ue(), b.take(1)
        if b.take(1):
            for i in range(12 if chroma == 3 else 8):
                if b.take(1):
                    last = following = 8
                    for _ in range(16 if i < 6 else 64):
                        if following:
                            following = (last + b.se()) % 256
                        last = following or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.take(1), b.se(), b.se()
        n = b.ue()
        if n > 256:
            return None
        for _ in range(n):
            b.se()
    b.ue(), b.take(1)
    across, down, frames = b.ue() + 1, b.ue() + 1, b.take(1)
    if not frames:
        b.take(1)
    b.take(1)
    crop = [b.ue() for _ in range(4)] if b.take(1) else [0] * 4
    wide = 2 if chroma in (1, 2) and not separate else 1
    tall = (2 if chroma == 1 and not separate else 1) * (2 - frames)
    short = b.short  # what follows may be cut off without the size being wrong
    colour = _colour(b) if b.take(1) else None
    width, height = across * 16 - wide * (crop[0] + crop[1]), down * 16 * (2 - frames) - tall * (crop[2] + crop[3])
    return None if short or not (0 < width <= 16384 and 0 < height <= 16384) else VideoShape(width, height, profile, level, None, constraints, colour)


def _skip_scaling_lists(b: Bits) -> None:
    for size in range(4):
        for _ in range(0, 6, 3 if size == 3 else 1):
            if not b.take(1):
                b.ue()
                continue
            if size > 1:
                b.se()
            for _ in range(min(64, 1 << 4 + 2 * size)):
                b.se()


def _skip_reference_sets(b: Bits, n: int) -> None:
    deltas: list[int] = []
    for i in range(n):
        if i and b.take(1):  # predicted from the set before
            b.take(1), b.ue()
            kept = 0
            for _ in range(deltas[-1] + 1):
                kept += 1 if b.take(1) else b.take(1)
            deltas.append(kept)
        else:
            before, after = b.ue(), b.ue()
            if before + after > 32:
                b.short = True
                return
            for _ in range(before + after):
                b.ue(), b.take(1)
            deltas.append(before + after)


def hevc_sps(nal: bytes) -> VideoShape | None:
    """Size less the conformance window, profile, tier, level and colour; None if the set is truncated or implausible."""
    b = Bits(without_emulation(nal[2:]))
    b.take(4)
    layers = b.take(3)
    b.take(1), b.take(2)
    tier, profile = b.take(1), b.take(5)
    b.take(32), b.take(48)
    level = b.take(8)
    present = [(b.take(1), b.take(1)) for _ in range(layers)]
    if layers:
        b.take(2 * (8 - layers))
    for has_profile, has_level in present:
        b.take(88 * has_profile + 8 * has_level)
    b.ue()
    chroma = b.ue()
    separate = b.take(1) if chroma == 3 else 0
    width, height = b.ue(), b.ue()
    crop = [b.ue() for _ in range(4)] if b.take(1) else [0] * 4
    wide, tall = (2 if chroma in (1, 2) and not separate else 1), (2 if chroma == 1 and not separate else 1)
    width, height = width - wide * (crop[0] + crop[1]), height - tall * (crop[2] + crop[3])
    short = b.short
    b.ue(), b.ue()
    poc = b.ue() + 4
    for _ in range(1 if not b.take(1) else layers + 1):
        b.ue(), b.ue(), b.ue()
    for _ in range(6):
        b.ue()
    if b.take(1) and b.take(1):
        _skip_scaling_lists(b)
    b.take(2)
    if b.take(1):
        b.take(8), b.ue(), b.ue(), b.take(1)
    sets = b.ue()
    if sets <= 64:
        _skip_reference_sets(b, sets)
        if b.take(1):
            for _ in range(min(b.ue(), 33)):
                b.take(poc + 1)
        b.take(2)
    colour = _colour(b) if sets <= 64 and b.take(1) and not b.short else None
    return None if short or not (0 < width <= 16384 and 0 < height <= 16384) else VideoShape(width, height, profile, level, tier, None, colour)


def keyframes(data: bytes, codec: str = "h264", whole: bool = True) -> tuple[bool, bool | None] | None:
    """Whether video opens on a keyframe and whether it holds one; None if no picture is seen.

    ``whole``: the bytes are all there are. Where they are cut, a keyframe not seen is unknown.
    """
    units = nal_units(data)
    if codec == "hevc":
        kinds = [u[0] >> 1 & 63 for u in units if u]
        pictures = [16 <= k <= 21 for k in kinds if k < 32]
    else:
        kinds = [u[0] & 31 for u in units if u]
        pictures = [k == 5 for k in kinds if 1 <= k <= 5]
    if not pictures:
        return None
    return pictures[0], True if any(pictures) else False if whole else None


def shape_of(data: bytes, codec: str) -> VideoShape | None:
    """The first parameter set that can be read."""
    for u in nal_units(data, 64):
        found = hevc_sps(u) if codec == "hevc" and len(u) > 2 and u[0] >> 1 & 63 == 33 else avc_sps(u) if codec == "h264" and u and u[0] & 31 == 7 else None
        if found:
            return found
    return None
