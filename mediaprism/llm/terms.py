"""Terms of whole texts: runs of kept bytes of the UTF-8 form, in which only A-Z are lower-cased.

All bytes of characters beyond ASCII are kept, so cutting bytes cuts no character.
"""

from __future__ import annotations

from collections.abc import Iterator

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_CHUNK = 4 << 20


def _table(kept: bytes) -> bytes:
    low = bytes.maketrans(_UPPER, _LOWER)
    return bytes(low[i] if i > 127 or low[i] in kept else 32 for i in range(256))


#: Runs of letters and of characters beyond ASCII; the same with digits.
LETTERS, ALNUM = _table(_LOWER), _table(_LOWER + _DIGITS)


def terms(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    text = text.translate(table)
    at = 0
    while len(text) - at > _CHUNK:
        end = text.find(b" ", at + _CHUNK)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()
