"""Exact shortcuts to public tokenizers: words are encoded once and then looked up.

What is looked up is bounded in bytes: words above 64 characters and words beyond ``room`` bytes are
encoded anew each time, so a task's memory does not grow with its input.
"""

from __future__ import annotations

import heapq
import json
import operator
import re
import struct
import unicodedata

import regex
from tokenizers import Tokenizer

from mediaprism.llm.common import Kept, resident

# The pattern by which the byte-level vocabulary splits text before its merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The pattern by which the vocabulary with word ends finds words in lower-case text.
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Printable ASCII, line breaks and the letters and signs of Latin-1: for texts of these alone,
#: composing is the identity and ``str.split`` and ``str.lower`` agree with the tokenizer.
_PLAIN = re.compile("[^\t\n\r -~\xa1-\xff]")
#: The letters and the digits among them after ``str.lower``, as that pattern's classes have them, and the pattern in these terms.
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+").findall


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class WordIds:
    """Token ids of whole texts as little-endian 32-bit values, for ``word_bpe_49k.json``.

    Words are found in the whole text by the pattern and looked up one by one; what is looked up is words, not what
    stands between white space, as there are far fewer of the former. Texts with other characters than plain
    ones, or with a special string in them, go through the library whole.
    """

    def __init__(self, path: str, room: int = 64 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        spec = _spec(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.quick = spec["model"].get("end_of_word_suffix") == "</w>" and WORD_ENDS in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        model, symbols, number = self.tokenizer.model, byte_symbols(), operator.attrgetter("id")

        def ids_of(word: str) -> bytes:
            found = list(map(number, model.tokenize(word.encode().decode("latin-1").translate(symbols))))
            return struct.pack(f"<{len(found)}I", *found)

        self.words = self.chunks = Kept(ids_of, room)  # one table; a chunk is a word here

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.quick or _PLAIN.search(text) or any(s in text for s in self.specials):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, _PLAIN_WORDS(text.lower())))


def merged_length(symbols: list, ranks: dict[tuple, tuple]) -> int:
    """How many symbols are left when byte-pair merging has ended.

    A doubly linked list holds the symbols, a heap the adjacent pairs by rank and place. The
    lowest pair is popped again and again; if both ends still are what they were when it was
    pushed, the left one becomes the merged symbol, the right one is unlinked and the two new
    pairs are pushed. The result is the initial symbols minus the merges; no ids are made.
    """
    n = left = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        if (r := get((symbols[i], symbols[i + 1]))) is not None:
            heap.append((r[0], i, symbols[i], symbols[i + 1], r[1]))
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        _, i, a, b, both = pop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = both, None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := get((both, symbols[k]))) is not None:
                push(heap, (r[0], i, both, symbols[k], r[1]))
        if (h := before[i]) >= 0 and (r := get((symbols[h], both))) is not None:
            push(heap, (r[0], h, symbols[h], both, r[1]))
    return left


class ByteCounts:
    """Token counts of whole texts for ``byte_bpe_50k.json``, as the library's ids would number.

    The pattern that splits texts asks which characters are letters and digits. This interpreter's tables
    and the library's agree on all characters that Unicode 15.1 assigns; a text with any other one is split
    by the library itself, and merged here all the same.
    """

    def __init__(self, path: str, room: int = 64 << 20):
        spec = _spec(path)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.ranks = {m: (r, m[0] + m[1]) for r, m in enumerate(merges)}
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        symbols = byte_symbols()
        self.split = regex.compile(BYTE_LEVEL).findall
        self.words = Kept(lambda word: merged_length(list(word.encode().decode("latin-1").translate(symbols)), self.ranks), room // 2)
        self.pieces = Kept(lambda piece: sum(map(self.words.__getitem__, self.split(piece))), room // 2)
        self.at_special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.assigned: set[str] = set()

    def _agreed(self, text: str) -> bool:
        """Whether both tables know all characters of the text."""
        if text.isascii():
            return True
        new = set(text) - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.assigned |= new
        return True

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if not self._agreed(text):
            return sum(merged_length(list(piece), self.ranks) for piece, _ in self.pre.pre_tokenize_str(text))
        if "  " in text:  # runs of spaces: the pattern has to see what follows
            return sum(map(self.words.__getitem__, self.split(text)))
        # A token never reaches over the start of a single space, so pieces that begin there count apart.
        first, *rest = text.split(" ")
        return self.pieces[first] + sum(map(self.pieces.__getitem__, [" " + x for x in rest]))

    def count(self, text: str | None) -> int:
        """Special strings inside a text are one token each, as by the library's default."""
        if not text:
            return 0
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


def word_ids(path: str) -> WordIds:
    return resident(WordIds, path)


def byte_counts(path: str) -> ByteCounts:
    return resident(ByteCounts, path)
