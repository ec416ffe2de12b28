"""Where the samples of a movie fragment lie, and what is read at those places: captions, cues and pictures.

A run's data begins at its own offset from the fragment's base (stated, or the fragment's own first byte), or where the run before it
ended; each sample follows the one before. A sample that does not lie in the bytes at hand is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from mediaprism.media.captions import seen_in, services


@dataclass(frozen=True, slots=True)
class Sample:
    offset: int
    size: int
    #: Presentation time and duration in the track's ticks.
    at: int
    lasts: int


def units(data: bytes, width: int) -> Iterator[bytes]:
    """Units of a sample, each behind its length in ``width`` bytes; a cut last one is left out."""
    i = 0
    while i + width <= len(data):
        size = int.from_bytes(data[i : i + width], "big")
        i += width
        if size and i + size <= len(data):
            yield data[i : i + size]
        i += size


def pictures(data: bytes, codec: str, width: int) -> list[bool]:
    """Of the pictures in a sample, which are keyframes."""
    if codec == "hevc":
        kinds = [u[0] >> 1 & 63 for u in units(data, width)]
        return [16 <= k <= 21 for k in kinds if k < 32]
    kinds = [u[0] & 31 for u in units(data, width)]
    return [k == 5 for k in kinds if 1 <= k <= 5]


def video_captions(bodies: list[bytes], codec: str, width: int) -> list[str]:
    return seen_in((u for body in bodies for u in units(body, width)), codec)


def _boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    i = 0
    while i + 8 <= len(data):
        size = int.from_bytes(data[i : i + 4], "big")
        if size < 8 or i + size > len(data):
            return
        yield data[i + 4 : i + 8], data[i + 8 : i + size]
        i += size


def track_captions(bodies: list[bytes], codec: str) -> list[str]:
    """Fields and services that a caption track carries: pairs of the first and second field, or packets of services."""
    found: set[str] = set()
    for body in bodies:
        for kind, inner in _boxes(body):
            if codec == "c608" and kind in (b"cdat", b"cdt2"):
                if any(a & 127 or b & 127 for a, b in zip(inner[::2], inner[1::2], strict=False)):
                    found.add("field1" if kind == b"cdat" else "field2")
            elif codec == "c708" and kind == b"ccdp" and inner:
                found |= {f"SERVICE{n}" for n in services(inner)} or {"c708"}
    return sorted(found)


def is_cue(body: bytes) -> bool:
    """Whether a text sample shows something: it holds a cue box, where an empty one says that nothing is shown."""
    return any(kind == b"vttc" for kind, _ in _boxes(body))
