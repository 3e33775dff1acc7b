"""Vectorised word scanning: words of many texts at once as positions and 64-bit hashes.

Works on UTF-8 bytes.  Every byte of a multi-byte character is at least 0x80, so
byte classes that treat 0x80..0xFF alike split exactly where the character
patterns do.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: ``[^\\x20\\x09-\\x0D]``.
SPACED = np.ones(256, bool)
SPACED[0x20] = SPACED[0x09:0x0E] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Powers are products of two table entries; this many bits of the exponent stand in the lower table.
_LOW = 16


@lru_cache(1)
def _powers(high: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For the hash base and its inverse: powers below 2**_LOW, and ``high`` powers of the 2**_LOW-th."""
    out = []
    for base in (_BASE, _INV):
        pair = []
        for step, n in ((int(base), 1 << _LOW), (pow(int(base), 1 << _LOW, 1 << 64), high)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        out.append(tuple(pair))
    return tuple(out)


def _tables(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    return _powers(1 << max(6, (int(n) >> _LOW).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (values[j] + 1) * base**j below i, modulo 2**64."""
    (low, high), _ = _tables(len(values))
    h = np.zeros(len(values) + 1, np.uint64)
    for k, a in enumerate(range(0, len(values), 1 << _LOW)):
        x = values[a : a + (1 << _LOW)].astype(np.uint64)
        x += np.uint64(1)
        x *= low[: len(x)]
        x *= high[k]
        x[:1] += h[a : a + 1]
        np.cumsum(x, out=h[a + 1 : a + 1 + len(x)])
    return h


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), wherever they stand."""
    _, (low, high) = _tables(len(h))
    inv = low[start & ((1 << _LOW) - 1)] * high[start >> _LOW]
    return mix((h[end] - h[start]) * inv + (end - start).astype(np.uint64) * _M2)


#: Bytes whose hash sums are held at once.
PIECE = 1 << 20


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending words, piece by piece; a word longer than a piece makes its own."""
    out, a = np.zeros(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + PIECE, "right")))
        at = start[a]
        out[a:b] = spans(prefix(low[at : end[b - 1]]), start[a:b] - at, end[a:b] - at)
        a = b
    return out


class Words:
    """Words of the texts ``buf[off[i]:off[i+1]]``.

    ``start``, ``end``: byte positions of each word; ``hash``: its 64-bit hash;
    ``first[i]:first[i+1]``: the words of text i; ``low``: lower-cased bytes.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray = ALNUM):
        self.off, self.low = off, LOWER[buf]
        n = len(buf)
        inside = np.zeros(n + 2, bool)
        inside[1 : n + 1] = table[self.low]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        before, at = inside[:-1], inside[1:]
        self.start = np.flatnonzero(at & (~before | cut))
        self.end = np.flatnonzero(before & (~at | cut))
        self.first = np.searchsorted(self.start, off)
        self.hash = word_hashes(self.low, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def doc(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))


def word_hash(word: bytes) -> int:
    """The hash that :class:`Words` gives this (lower-cased) word."""
    b = np.frombuffer(word, np.uint8)
    return int(spans(prefix(b), np.array([0]), np.array([len(b)]))[0])


def runs(words: Words, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at every word (undefined where a text ends before)."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    if n >= k:
        acc = words.hash[: n - k + 1].copy()
        for j in range(1, k):
            acc *= _BASE
            acc += words.hash[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes: (hashes, offsets).

    A text with fewer than k words but at least one gives its whole sequence as
    one shingle; a text without words gives none.
    """
    h, first = runs(words, k), words.first
    out, off = [], [0]
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            x = np.sort(h[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in words.hash[a:b]:
                    acc = acc * _BASE + v
            x = mix(np.array([acc], np.uint64))
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
        off.append(off[-1] + len(x))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(off)
