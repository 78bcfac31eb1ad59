"""Texts as numpy arrays: code points, character classes, words and their hashes.

The operators that must read every character in Python do so here, a batch of
texts at a time, without a Python loop over characters or words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Classes of code points.
OTHER, SPACE, LOWER, UPPER, DIGIT, PUNCT, SYMBOL, LETTER, COMBINING = range(9)
#: Marks that ordinary prose uses; all other marks are SYMBOL. Fixed values.
PROSE_MARKS = ".,;:?!'\"()-–—…«»‘’“”¿¡"
#: Characters that are held as arrays at once.
PART = 2_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or 0xF0000 <= i or 0x323B0 <= i < 0xE0000:
            continue  # surrogates, private planes, unassigned
        c = chr(i)
        kind = unicodedata.category(c)
        if c.isspace():
            out[i] = SPACE
        elif kind[0] == "L":
            out[i] = UPPER if kind in ("Lu", "Lt") else LOWER if kind == "Ll" else LETTER
        elif kind[0] == "N":
            out[i] = DIGIT
        elif c in PROSE_MARKS:
            out[i] = PUNCT
        elif kind[0] in "PS":
            out[i] = SYMBOL
        elif kind[0] == "M":
            out[i] = COMBINING
    return out


def wordlike(kind: np.ndarray) -> np.ndarray:
    """Whether characters of these classes make up words: letters and the marks that combine with them."""
    return (kind == LOWER) | (kind == UPPER) | (kind == LETTER) | (kind == COMBINING)


def parts(texts: Sequence[str | None], limit: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each; a longer text stands alone, whole."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a newline after each text, and where each text starts."""
    lengths = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    joined = "\n".join(t or "" for t in texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum(lengths)[:-1]])


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    p = np.empty(4096, dtype=np.uint64)
    p[0] = 1
    for i in range(1, len(p)):
        p[i] = np.uint64(int(p[i - 1]) * 0x9E3779B97F4A7C15 % (1 << 64))
    return p


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(cps: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each maximal run of `inside`. The last code point must not be inside."""
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(at)) - at
    values = cps[inside].astype(np.uint64) * _powers()[place & 4095]
    sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
    return starts, mix(sums + lengths.astype(np.uint64))
