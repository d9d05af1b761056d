"""Vectorised hashes of character n-grams and words over whole batches of texts.

Texts are joined with spaces into one array of code points, every separator becomes a space, and a gram is a window of
``n`` characters within a word and the spaces beside it. A batch is worked on in parts of about ``PIECE`` characters. Very long texts are
cut at separators only, so every word and gram is that of the whole text and a task's memory grows with the longest word, not with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19
SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Characters that separate words: white space and controls; or every ASCII character that isn't a letter.
WHITE = "".join(map(chr, range(33)))
NO_LETTER = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x ^= x >> np.uint64(29)
    return x


class Separators:
    """Replaces separators by spaces; strings and arrays of code points alike."""

    def __init__(self, characters: str) -> None:
        self.table = np.arange(128, dtype=np.uint32)
        self.table[[ord(c) for c in characters]] = SPACE
        self.pattern = re.compile("[" + re.escape(characters) + "]")

    def codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(codes < 128, self.table[np.minimum(codes, 127)], codes)

    def next(self, text: str, at: int) -> int:
        """The place of the first separator from ``at`` on, or the text's end."""
        found = self.pattern.search(text, at)
        return found.start() if found else len(text)


def pieces(texts: list[str], separators: Separators) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points with a space before, between and after parts; the place of the space before each part; each part's text number).

    Parts of one text follow one another; only long texts have several.
    """
    parts: list[str] = []
    owners: list[int] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64))).astype(np.int64)
        return separators.codes(" " + " ".join(parts) + " "), starts, np.array(owners)

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = separators.next(text, at + PIECE) if len(text) - at > PIECE else len(text)
            parts.append(text[at:end])
            owners.append(k)
            size += end - at
            at = end
            if size >= PIECE:
                yield joined()
                parts, owners, size = [], [], 0
    if parts:
        yield joined()


def grams(codes: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, start positions, hashes) of the windows of each order that have spaces at their ends at most, and not only spaces."""
    wide = codes.astype(np.uint64)
    inner = codes == SPACE
    h = np.zeros(len(codes), np.uint64)
    blocked = np.zeros(len(codes), bool)
    for n in range(1, max(orders) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = (h[:m] * _MIX) + wide[n - 1 :] + np.uint64(1)
        if n > 2:
            blocked = blocked[:m] | inner[n - 2 : n - 2 + m]
        if n in orders:
            bad = blocked[:m] if n > 2 else inner[:m] & inner[n - 1 :]
            at = np.flatnonzero(~bad)
            yield n, at, mix(h[at] + np.uint64(n))


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run without spaces. The array starts and ends with a space."""
    space = codes == SPACE
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    place = (np.arange(len(codes)) - np.maximum.accumulate(first)).astype(np.uint64)
    value = mix((codes.astype(np.uint64) + np.uint64(1)) * _MIX + (place % np.uint64(1 << 20)) * _STEP)
    value[space] = 0
    return starts, mix(np.add.reduceat(value, starts) + np.uint64(99))
