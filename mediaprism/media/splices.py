"""Splice information sections: commands, times and segmentation descriptors."""

from __future__ import annotations

import struct

from mediaprism.media.bits import Bits

TURN = 1 << 33
# Commands by number, and the identifier types whose bytes are text.
COMMANDS = {0x00: "splice_null", 0x04: "splice_schedule", 0x05: "splice_insert", 0x06: "time_signal", 0x07: "bandwidth_reservation", 0xFF: "private_command"}
TEXT_UPIDS = (0x01, 0x02, 0x03, 0x07, 0x09, 0x0E, 0x0F)


def _time(b: Bits) -> int | None:
    if b.take(1):
        b.take(6)
        return b.take(33)
    b.take(7)
    return None


def splice(section: bytes) -> dict | None:
    """command, pts (adjusted, null if none is stated), event_id, out_of_network, duration, segmentation_type, upid; None if damaged."""
    b = Bits(section)
    if b.take(8) != 0xFC:
        return None
    b.take(16)  # flags and length
    b.take(8)  # version
    hidden = b.take(1)
    b.take(6)
    adjustment = b.take(33)
    b.take(20)  # clear word and tier
    size, kind = b.take(12), b.take(8)
    out = dict.fromkeys(("pts", "event_id", "out_of_network", "duration", "segmentation_type", "upid")) | {"command": COMMANDS.get(kind, f"0x{kind:02x}")}
    if b.short:
        return None
    if hidden:
        return out
    start = b.left
    pts = None
    insert = None
    if kind == 0x05:
        insert = b.take(32)
        cancelled = b.take(1)
        b.take(7)
        if not cancelled:
            out["out_of_network"], program, has_duration, immediate = bool(b.take(1)), b.take(1), b.take(1), b.take(1)
            b.take(4)
            if program and not immediate:
                pts = _time(b)
            elif not program:
                for _ in range(b.take(8)):
                    b.take(8)
                    if not immediate:
                        _time(b)
            if has_duration:
                b.take(7)
                out["duration"] = b.take(33)
    elif kind == 0x06:
        pts = _time(b)
    if size != 0xFFF:
        b.left = start - size * 8 if start >= size * 8 else 0
    if pts is not None:
        out["pts"] = (pts + adjustment) % TURN
    rest = b.take(16)
    while rest >= 2 and not b.short:
        tag, length = b.take(8), b.take(8)
        end = b.left - length * 8
        if end < 0:
            return None
        if tag == 0x02 and length >= 9 and b.take(32) == 0x43554549:
            out["event_id"], cancelled = b.take(32), b.take(1)
            b.take(7)
            if not cancelled:
                program, timed = b.take(1), b.take(1)
                b.take(6)
                if not program:
                    for _ in range(b.take(8)):
                        b.take(48)
                if timed:
                    out["duration"] = b.take(40)
                upid_type, n = b.take(8), b.take(8)
                raw = bytes(b.take(8) for _ in range(n))
                out["upid"] = (raw.decode("ascii") if upid_type in TEXT_UPIDS and all(32 <= x < 127 for x in raw) else raw.hex()) if raw else None
                out["segmentation_type"] = b.take(8)
        b.left = end
        rest -= 2 + length
    if insert is not None:
        out["event_id"] = insert
    return None if b.short else out


def emsg(data: bytes, start: int | None, scale: int) -> dict | None:
    """An event message box's payload: scheme, value, id, pts (in ``scale`` ticks), duration, and the splice in it, if it holds one.

    Version 0 counts from the fragment's ``start`` (in ``scale`` ticks), version 1 from zero, both in their own timescale.
    """
    if len(data) < 4:
        return None
    version, i = data[0], 4
    numbers: tuple[int, ...] = ()
    if version == 1:
        if len(data) < 26:
            return None
        numbers, i = struct.unpack_from(">IQII", data, 4), 24
    scheme, _, rest = data[i:].partition(b"\0")
    value, _, rest = rest.partition(b"\0")
    if version == 0:
        if len(rest) < 16:
            return None
        numbers, rest = struct.unpack_from(">IIII", rest, 0), rest[16:]
    own, at, length, number = numbers
    if not own:
        return None
    ticks = at * scale // own
    pts = ticks if version == 1 else None if start is None else start + ticks
    return {"scheme": scheme.decode("utf-8", "replace"), "value": value.decode("utf-8", "replace"), "id": number, "pts": pts, "duration": None if length == 0xFFFFFFFF else length * scale // own, "splice": splice(rest) if b"scte35" in scheme else None}
