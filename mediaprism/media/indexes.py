"""Segment indexes, and single-file renditions expanded by them."""

from __future__ import annotations

import struct
from collections.abc import Callable

from mediaprism.media.containers import boxes

MOST_DEPTH = 4


def sidx(data: bytes, at: int = 0) -> dict | None:
    """The first index box: timescale and entries (offset, size, duration, sap, is_index); offsets count from byte 0 of the file, where ``data`` begins at ``at``."""
    for kind, a, b in boxes(data):
        if kind != "sidx" or b - a < 24:
            continue
        version, scale = data[a], struct.unpack_from(">I", data, a + 8)[0]
        wide = ">QQ" if version else ">II"
        _, first = struct.unpack_from(wide, data, a + 12)
        i = a + 12 + struct.calcsize(wide)
        n = struct.unpack_from(">H", data, i + 2)[0]
        i += 4
        if i + 12 * n > b or not scale:
            return None
        offset, entries = at + b + first, []
        for k in range(n):
            size, length, sap = struct.unpack_from(">III", data, i + 12 * k)
            entries.append({"offset": offset, "size": size & 0x7FFFFFFF, "duration": length, "sap": bool(sap >> 31), "is_index": bool(size >> 31)})
            offset += size & 0x7FFFFFFF
        return {"timescale": scale, "entries": entries, "start": at + a - 8}
    return None


def expand(index: dict | None, read: Callable[[int, int], bytes], depth: int = 1) -> list[dict]:
    """Media entries in order; entries that are indexes are read and replaced by theirs, less than four deep."""
    out: list[dict] = []
    for e in index["entries"] if index else []:
        if not e["is_index"]:
            out.append(e | {"timescale": index["timescale"]})
        elif depth < MOST_DEPTH:
            out += expand(sidx(read(e["offset"], e["size"]), e["offset"]), read, depth + 1)
    return out
