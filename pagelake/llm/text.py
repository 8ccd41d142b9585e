"""Small helpers for words and their hashes, shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

# What lies between words: the ASCII blanks 0x20 and 0x09 to 0x0D. ``bytes.split`` parts at just these.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Words of letters and digits: ASCII letters in lower case, digits, and every character beyond ASCII; the rest parts words.
ALNUM = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
LOWER = bytes(range(256)).lower()
PLAIN = bytes(range(256))

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 17
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return data.translate(ALNUM).split()


class WordHasher:
    """64-bit hashes of the words of texts, by numpy over the bytes of many texts at once.

    A word's hash is a polynomial of the values of its bytes in 64-bit arithmetic, mixed with its length. It is read off
    running sums, so a word costs the same wherever it stands. ``table`` maps bytes first (``PLAIN``, ``LOWER``, ``ALNUM``).
    Memory is bounded: about a hundred bytes for each byte of a chunk of ``_CHUNK``, or of a longer single word.
    """

    def __init__(self, table: bytes = PLAIN):
        self.in_word = np.array([b not in BLANKS for b in table], np.int8)
        self.values = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in table], np.uint64) * self.in_word.astype(np.uint64)
        self._powers(_CHUNK)

    def _powers(self, n: int) -> None:
        n = 1 << n.bit_length()
        self.powers = np.cumprod(np.full(n, _MULTIPLIER, np.uint64))
        self.inverses = np.cumprod(np.full(n, _INVERSE, np.uint64))

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words of a stretch of bytes, where they start and where they end."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > len(self.powers):
            self._powers(len(raw))
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = self.in_word[raw]
        turns = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = turns[::2], turns[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends

    def _chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a chunk's words, and where they start."""
        return self.spans(data)[:2]

    def each(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The word hashes of every text, in order; a null is an empty text."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if group and size + len(text) > _CHUNK:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > _CHUNK:
                yield np.concatenate([self._chunk(piece)[0] for piece in pieces(text)])
            else:
                group.append(text)
                size += len(text) + 1
        if group:
            yield from self._group(group)

    def _group(self, group: list[bytes]) -> Iterator[np.ndarray]:
        hashes, starts = self._chunk(b" ".join(group))
        edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in group)]))
        for a, b in zip(edges[:-1], edges[1:]):
            yield hashes[a:b]

    def of(self, words: list[bytes]) -> np.ndarray:
        """Hashes of single words."""
        return self._chunk(b" ".join(words))[0]


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at blanks."""
    since = 0
    while since < len(text):
        cut = _BLANK.search(text, since + _CHUNK - 1) if since + _CHUNK < len(text) else None
        until = cut.end() if cut else len(text)
        yield text[since:until]
        since = until


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words: a polynomial in 64-bit arithmetic, then mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, width):
        total *= _MULTIPLIER
        total += hashes[i : i + n]
    return mix(total)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits may serve as a bucket."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))
