"""Sampled suffixes of byte texts: every 50-byte window picks one, by its content alone.

A window's smallest 5-byte gram, modulo the number of 28-byte grams, picks the
28-byte gram that stands for it (a mod-minimizer).  Equal windows pick the same
gram at the same place, wherever they stand, so a sparse suffix array over the
picked places finds all matches of 50 bytes.
"""

from __future__ import annotations

import numpy as np

from .wordscan import mix, prefix, spans

LENGTH, GRAM, SMALL = 50, 28, 5
_W = LENGTH - GRAM + 1
_SPAN = LENGTH - SMALL + 1


class Runs:
    """Runs of consecutive windows that pick the same place.

    ``first``, ``last``: the run's first and last window start; ``key``: hash of
    the 28 bytes at the picked place; ``context``: hash of all bytes of the
    run's windows and of the place within them; ``at[i]:at[i+1]``: runs of text i.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(buf)
        self.off, hashed = off, prefix(buf)
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.key = self.context = np.zeros(0, np.uint64)
        size = np.diff(off)
        if n >= LENGTH and (size >= LENGTH).any():
            g = np.zeros(n - SMALL + 1, np.uint64)
            for j in range(SMALL):
                g |= buf[j : n - SMALL + 1 + j].astype(np.uint64) << np.uint64(8 * j)
            bits = np.uint64(int(n).bit_length())
            g = (mix(g) >> bits) << bits
            g |= np.arange(len(g), dtype=np.uint64)
            reach = 1
            while 2 * reach <= _SPAN:
                g = np.minimum(g[:-reach], g[reach:])
                reach *= 2
            more = _SPAN - reach
            if more:
                g = np.minimum(g[:-more], g[more:])
            low = (g & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            at = np.arange(len(low))
            rel = low - at
            place = at + np.where(rel >= _W, rel - _W, rel)
            fine = np.zeros(len(low) + 1, np.int8)  # window starts within a text
            d = np.flatnonzero(size >= LENGTH)
            fine[off[d]] += 1
            fine[off[d + 1] - LENGTH + 1] -= 1
            good = np.cumsum(fine[:-1], dtype=np.int8) > 0
            new = good.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
            new[off[d]] = True
            end = good.copy()
            end[:-1] &= new[1:] | ~good[1:]
            self.first, self.last = np.flatnonzero(new), np.flatnonzero(end)
            p = place[self.first]
            self.key = spans(hashed, p, p + GRAM)
            self.context = mix(spans(hashed, self.first, self.last + LENGTH) + (p - self.first).astype(np.uint64))
        self.at = np.searchsorted(self.first, off)

    def __len__(self) -> int:
        return len(self.first)


def windows_of(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, number for each run) of all windows of runs given by their first and last starts."""
    n = last - first + 1
    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return start, spans(prefix(buf), start, start + LENGTH), n
