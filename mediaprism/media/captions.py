"""Captions in the supplemental messages of video, and which fields and services carry any."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from mediaprism.media.bits import nal_units, without_emulation

# Country, provider, identifier and type of messages that carry captions.
SIGN = b"\xb5\x00\x31GA94\x03"


def messages(units: Iterable[bytes], codec: str) -> Iterator[bytes]:
    """Payloads of user-data messages that carry captions."""
    for u in units:
        if codec == "hevc":
            if len(u) < 3 or u[0] >> 1 & 63 not in (39, 40):
                continue
            body = without_emulation(u[2:])
        elif u and u[0] & 31 == 6:
            body = without_emulation(u[1:])
        else:
            continue
        i = 0
        while i + 2 <= len(body) and body[i] != 0x80:
            kind = size = 0
            while i < len(body) and body[i] == 255:
                kind, i = kind + 255, i + 1
            kind, i = kind + (body[i] if i < len(body) else 0), i + 1
            while i < len(body) and body[i] == 255:
                size, i = size + 255, i + 1
            size, i = size + (body[i] if i < len(body) else 0), i + 1
            if kind == 4 and body[i : i + len(SIGN)] == SIGN:
                yield body[i + len(SIGN) : i + size]
            i += size


def services(packet: bytes) -> set[int]:
    """Services with a block that is not empty, of one packet."""
    found, i = set(), 1
    size = (packet[0] & 63) * 2 or 128
    while i < min(size, len(packet)):
        number, length, i = packet[i] >> 5, packet[i] & 31, i + 1
        if number == 7 and length:
            if i >= len(packet):
                break
            number, i = packet[i] & 63, i + 1
        if number == 0:
            break
        if length:
            found.add(number)
        i += length
    return found


def seen(data: bytes, codec: str) -> list[str]:
    """What video between start codes carries, as ``seen_in``."""
    return seen_in(nal_units(data), codec)


def seen_in(units: Iterable[bytes], codec: str) -> list[str]:
    """``field1``, ``field2`` and ``SERVICEn`` that carry data, in order of name."""
    found: set[str] = set()
    packet = b""
    for m in messages(units, codec):
        if len(m) < 2 or not m[0] & 64:
            continue
        for k in range(m[0] & 31):
            t = m[2 + 3 * k : 5 + 3 * k]
            if len(t) < 3 or not t[0] & 4:
                continue
            kind = t[0] & 3
            if kind < 2:
                if (t[1] & 127, t[2] & 127) != (0, 0):
                    found.add(f"field{kind + 1}")
                continue
            if kind == 3:
                if packet:
                    found |= {f"SERVICE{n}" for n in services(packet)}
                packet = t[1:]
            elif packet:
                packet += t[1:]
    if packet:
        found |= {f"SERVICE{n}" for n in services(packet)}
    return sorted(found)
