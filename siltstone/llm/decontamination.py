"""Benchmark decontamination by spaced-seed hashing.

A mask is a pattern of compared and ignored word positions.  Hashes of the
compared words at every position of the benchmark texts are looked up at every
position of every document, so a passage is hit although words at ignored
positions were replaced.  The masks are lossless: any stretch of enough words
with enough of them equal holds a seed of one mask at least.  Around each hit
the words are compared first, and where a stretch passes, the text is aligned
with the item word by word and the best of its long enough stretches is kept.

The benchmark is cut into blocks of bounded size; a block's hashes are shipped
to all tasks, and documents are scanned once for each block.  Documents are
never shuffled; hits are verified where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, flat, mapped
from .wordscan import ALNUM, Words, mix

#: Masks of five compared words; ``1`` is compared.  One of them meets every stretch of 13 words or more
#: with 75 % equal: such a stretch can be cut to one of at most ``REACH`` words, and those were enumerated.
MASKS = ["111011", "1100001011", "1100010000011"]
#: The same for whole items of fewer words.
SHORT_MASKS = {
    1: ["1"], 2: ["11"], 3: ["111"], 4: ["111", "1101", "1011"], 5: ["111", "1101"], 6: ["1111", "11011"], 7: ["11111", "111011", "110111"],
    8: ["11011", "1111", "1100011"], 9: ["11101", "100111"], 10: ["111011", "11010011", "11111"], 11: ["1101011", "1110011"], 12: ["11101", "10111"],
}
#: Words that a verified overlap spans at least (or the whole item, if shorter), and the share that agrees.
MIN_SPAN, MIN_IDENTITY, PENALTY = 13, 0.75, 3
#: A stretch of twice ``MIN_SPAN`` words has a half that passes, so a shortest one is below that.
REACH = 2 * MIN_SPAN - 1
#: Hits of one diagonal are looked at together over so many words, and so many places at a time.
STEP, PLACES = 16, 1 << 13
#: Benchmark words in one block.
BLOCK_WORDS = 1 << 20

_ODD = np.uint64(0xD6E8FEB86659FD93)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[at[0] : at[0] + n].copy()
    for i in at[1:]:
        acc *= _ODD
        acc += h[i : i + n]
    return mix(acc)


class Seeds:
    """One block of benchmark texts, hashed by all masks."""

    def __init__(self, ids: list, texts: list[str], masks: list[str] = MASKS):
        buf, off = flat(pa.array(texts, pa.string()))
        w = Words(buf, off, ALNUM)
        self.ids, self.hash, self.first = ids, w.hash, w.first
        self.least = np.minimum(np.diff(w.first), MIN_SPAN)
        doc = w.doc()
        filed: dict[str, list[int]] = {m: [MIN_SPAN] for m in masks}
        for n in np.unique(self.least[(self.least > 0) & (self.least < MIN_SPAN)]).tolist():
            for m in SHORT_MASKS[n]:
                filed.setdefault(m, []).append(n)
        self.masks, self.tables = [], []
        for mask, sizes in filed.items():
            h = _seeds(w.hash, mask)
            at = np.arange(len(h))
            at = at[doc[at] == doc[at + len(mask) - 1]] if len(h) else at
            at = at[np.isin(self.least[doc[at]], sizes)]
            order = np.argsort(h[at], kind="stable")
            key, pos = h[at][order], at[order]
            bits = np.zeros(1 << 22, bool)
            bits[(key >> np.uint64(42)).astype(np.int64)] = True
            if len(key):
                self.masks.append(mask)
                self.tables.append((key, pos, np.packbits(bits)))

    def find(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text number, item number, diagonal) where a stretch passes, each once: word i of the text against word i - diagonal of the item."""
        doc = words.doc()
        got = []
        for mask, (key, pos, bits) in zip(self.masks, self.tables):
            h = _seeds(words.hash, mask)
            if not len(h):
                continue
            top = (h >> np.uint64(42)).astype(np.int64)
            maybe = np.flatnonzero(bits[top >> 3] >> (7 - (top & 7)).astype(np.uint8) & 1)
            maybe = maybe[doc[maybe] == doc[maybe + len(mask) - 1]]
            lo, hi = np.searchsorted(key, h[maybe], "left"), np.searchsorted(key, h[maybe], "right")
            maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            # common words bring many places: a bounded number is compared at a time
            cut = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PLACES, ends[-1], PLACES), "right"), [len(n)]])) if len(n) else [0]
            for a, b in zip(cut, cut[1:]):
                k = n[a:b]
                at = np.repeat(maybe[a:b], k)
                q = pos[np.repeat(lo[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                got.append(self._passing(words, doc, at, q))
        if got:
            yield from map(tuple, np.unique(np.concatenate(got), axis=0).tolist())

    def _passing(self, words: Words, doc: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The hits (word of a text, word of an item) with a passing stretch near them, as (text, item, diagonal)."""
        item = np.searchsorted(self.first, q, "right") - 1
        d, shift, block = doc[at], at - q, at // STEP
        order = np.lexsort((block, shift, item, d))
        d, item, shift, block = d[order], item[order], shift[order], block[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (block[1:] != block[:-1])
        d, item, shift, block = d[new], item[new], shift[new], block[new]
        ok = np.zeros(len(d), bool)
        for a in range(0, len(d), PLACES):
            s = slice(a, a + PLACES)
            lo = np.maximum(words.first[d[s]], self.first[item[s]] + shift[s])
            hi = np.minimum(words.first[d[s] + 1], self.first[item[s] + 1] + shift[s])
            p = (block[s] * STEP - REACH + 1)[:, None] + np.arange(STEP + 2 * REACH - 2)
            inside = (p >= lo[:, None]) & (p < hi[:, None])
            p = np.clip(p, lo[:, None], hi[:, None] - 1)
            agree = words.hash[p] == self.hash[p - shift[s][:, None]]
            score = np.zeros((len(p), p.shape[1] + 1), np.int32)
            np.cumsum(np.where(inside, np.where(agree, 1, -PENALTY), -1 << 16), axis=1, out=score[:, 1:])
            low = np.minimum.accumulate(score, axis=1)
            for m in np.unique(self.least[item[s]]):
                x = self.least[item[s]] == m
                ok[a + np.flatnonzero(x)] = (score[x, m:] >= low[x, : score.shape[1] - m]).any(1)
        d, item, shift = d[ok], item[ok], shift[ok]
        return np.stack([d, item, shift - words.first[d] + self.first[item]], 1)


def best_overlap(agree: np.ndarray, penalty: int = PENALTY, least: int = 0) -> tuple[int, int]:
    """The stretch [a, b) of ``least`` aligned words or more with the best score: 1 for a word that agrees, -penalty otherwise; the first of equals."""
    if len(agree) < least:
        return 0, 0
    s = np.concatenate([[0], np.cumsum(np.where(agree, 1, -penalty))])
    low = np.minimum.accumulate(s[: len(s) - least])
    b = int(np.argmax(s[least:] - low))
    a = int(np.flatnonzero(s[: b + 1] == low[b])[0])
    return a, b + least


def verified(words: Words, seeds: Seeds, doc: int, item: int, diagonal: int) -> tuple | None:
    """(matched, span, first word in the text, in the item) on one diagonal, if it passes."""
    a, b = int(words.first[doc]), int(words.first[doc + 1])
    c, d = int(seeds.first[item]), int(seeds.first[item + 1])
    lo, hi = max(0, -diagonal), min(d - c, b - a - diagonal)
    agree = words.hash[a + diagonal + lo : a + diagonal + hi] == seeds.hash[c + lo : c + hi]
    x, y = best_overlap(agree, least=min(MIN_SPAN, d - c))
    span, matched = y - x, int(agree[x:y].sum())
    if span < min(MIN_SPAN, d - c) or matched < MIN_IDENTITY * span:
        return None
    return matched, span, diagonal + lo + x, lo + x


COLUMNS = "doc_id long, item_id long, matched_words long, span_words long, doc_word long, item_word long, item_words long, identity double, contaminated boolean"


def _search(seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for part, buf, off in chunks(batches, "text"):
            words, best = Words(buf, off, ALNUM), {}
            for doc, item, diagonal in s.find(words):
                if v := verified(words, s, doc, item, diagonal):
                    k = (-v[0], v[1], v[2], v[3])
                    if (doc, item) not in best or k < best[doc, item]:
                        best[doc, item] = k
            if best:
                ids = part.column(0).to_pylist()
                rows = [(ids[d], s.ids[i], -m, n, p, q, int(s.first[i + 1] - s.first[i]), -m / n, True) for (d, i), (m, n, p, q) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 7 + [pa.float64(), pa.bool_()])], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Seeds]:
    """The benchmark in blocks of bounded size, fetched one after the other."""
    ids, texts, size, some = [], [], 0, False
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text) // 4 + 1
        if size > block_words:
            yield Seeds(ids, texts)
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield Seeds(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Verified overlaps: a row for each document and benchmark item that it holds, with the best overlap.

    Words are lower-cased runs of digits, letters and non-ASCII characters.  An
    overlap spans ``MIN_SPAN`` words, or the whole item where that is shorter,
    and ``MIN_IDENTITY`` of its words agree at their places; any such stretch
    counts, and the best-scoring one is reported.  Null or empty
    texts and items hold nothing; repeated rows and items are reported each;
    null ids stay null; empty tables give no rows; other columns are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast
    return reduce(DataFrame.union, (docs.select("doc_id", "text").transform(mapped(_search(share(s)), COLUMNS)) for s in blocks(benchmark, block_words)))


def _clean(seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for part, buf, off in chunks(batches, "text"):
            words, bad = Words(buf, off, ALNUM), np.zeros(part.num_rows, bool)
            for doc, item, diagonal in s.find(words):
                if not bad[doc] and verified(words, s, doc, item, diagonal):
                    bad[doc] = True
            yield part.filter(pa.array(~bad))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, in their own columns, without a shuffle."""
    share = docs.sparkSession.sparkContext.broadcast
    for s in blocks(benchmark, block_words):
        docs = docs.transform(mapped(_clean(share(s)), docs.schema))
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the passages."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
