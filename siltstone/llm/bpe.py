"""Token ids of whole texts by the ``tokenizers`` library, at memo speed.

The byte-level BPE model works on one pre-token at a time.  Pre-tokens are cut
here for many texts at once with array operations, each distinct pre-token is
encoded once by the library's own model, and ids are gathered from that memo.
Tests hold the result equal to ``Tokenizer.encode`` of the whole text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from .wordscan import prefix, spans

#: Bytes of text that are encoded at once: code points and hash sums take some forty times as much.
TEXT_BYTES = 1 << 20

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are pre-tokens of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    t = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = _LETTER
        elif k == "N":
            t[c] = _NUMBER
    t[WHITE_SPACE] = _SPACE
    return t


@lru_cache(1)
def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pretokens(cps: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Start positions of pre-tokens in concatenated code points; ``doc_at``: starts of non-empty texts."""
    n = len(cps)
    kind = _classes()[cps]
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    head = np.zeros(n, bool)
    head[doc_at] = True
    start |= head
    # a non-space run after white space: the run's last blank goes along if it is a plain one
    at = np.flatnonzero(start[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~head[1:]) + 1
    start[at - 1] = True
    glued = at[cps[at - 1] == 0x20]
    start[glued] = False
    # contractions: a lone apostrophe, no blank glued to it, with letters behind
    q = np.flatnonzero((cps[:-1] == 0x27) & start[:-1] & start[1:] & (kind[1:] == _LETTER) & ~head[1:])
    if len(q):
        end = np.append(head, True)  # positions where a text ends
        one = np.isin(cps[q + 1], [ord("s"), ord("t"), ord("m"), ord("d")])
        q2 = np.minimum(q + 2, n - 1)
        two = (q + 2 < n) & ~end[q + 2] & (((cps[q + 1] == ord("r")) | (cps[q + 1] == ord("v"))) & (cps[q2] == ord("e")) | (cps[q + 1] == ord("l")) & (cps[q2] == ord("l")))
        for k, hit in ((1, q[one]), (2, q[two])):
            start[hit + 1] = False
            nxt = hit + 1 + k
            nxt = nxt[nxt < n]
            start[nxt] = start[nxt] | (kind[nxt] == _LETTER)
    return np.flatnonzero(start)


class MemoTokenizer:
    """Encodes lists of texts; the memo is dropped when it is five eighths full, so memory is bounded."""

    BITS = 20
    LONG = 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        cut, added = tok.pre_tokenizer, tok.get_added_tokens_decoder()
        if tok.normalizer or type(cut).__name__ != "ByteLevel" or cut.add_prefix_space or not cut.use_regex:
            raise ValueError(f"{path}: only byte-level vocabularies without a normalizer or prefix space are cut here")
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError(f"{path}: added tokens with options aren't supported")
        self._added = {t.content: i for i, t in added.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None
        self._model = tok.model
        self._chars = _byte_chars()
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << self.BITS, np.uint64)
        self._slot = np.full(1 << self.BITS, -1, np.int32)
        self._at, self._len = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._ids, self._used, self._n = np.zeros(1 << 18, np.uint32), 0, 0

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token, by the library's model."""
        return [t.id for t in self._model.tokenize("".join(map(self._chars.__getitem__, word.encode())))]

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.BITS) - 1)
        at = (h & mask).astype(np.int64)
        got = self._slot[at]
        wrong = np.flatnonzero((got >= 0) & (self._keys[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(mask)
            got[wrong] = self._slot[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self._keys[at[wrong]] != h[wrong])]
        return got

    def _add(self, h: np.ndarray, words: list[str]) -> None:
        mask = (1 << self.BITS) - 1
        for x, w in zip(h.tolist(), words):
            ids = self.word_ids(w)
            if self._n == len(self._at):
                self._at, self._len = np.resize(self._at, 2 * self._n), np.resize(self._len, 2 * self._n)
            if self._used + len(ids) > len(self._ids):
                self._ids = np.resize(self._ids, max(2 * len(self._ids), self._used + len(ids)))
            self._ids[self._used : self._used + len(ids)] = ids
            self._at[self._n], self._len[self._n] = self._used, len(ids)
            self._used += len(ids)
            at = x & mask
            while self._slot[at] >= 0:
                at = (at + 1) & mask
            self._slot[at], self._keys[at] = self._n, x
            self._n += 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, offsets): text i has ids[off[i]:off[i+1]].

        As in the library, added tokens (``<|endoftext|>``) are found in a text
        first and stand for themselves.
        """
        if not any(a in t for t in texts for a in self._added):
            return self._plain(texts)
        cut = [self._cut.split(t) for t in texts]  # added tokens stand at odd places
        ids, off = self._plain([x for c in cut for x in c[::2]])
        out, size, k = [], [0], 0
        for c in cut:
            for i, x in enumerate(c):
                out.append(np.array([self._added[x]], np.uint32) if i % 2 else ids[off[k + i // 2] : off[k + i // 2 + 1]])
            k += len(c) // 2 + 1
            size.append(size[-1] + sum(map(len, out[len(out) - len(c) :])))
        return np.concatenate(out), np.array(size)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens."""
        whole = "".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start = pretokens(cps, (ends - size)[size > 0])
        end = np.append(start[1:], len(cps))
        h = spans(prefix(cps), start, end)
        if self._n > 5 << (self.BITS - 3):
            self._clear()
        at = self._find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            u, k = np.unique(h[new], return_index=True)
            k = new[k]
            for a in range(0, len(u), 1 << (self.BITS - 2)):
                b = a + (1 << (self.BITS - 2))
                if self._n + len(u[a:b]) > 3 << (self.BITS - 2):
                    self._clear()
                self._add(u[a:b], [whole[x:y] for x, y in zip(start[k[a:b]].tolist(), end[k[a:b]].tolist())])
            at = self._find(h)
            if (at < 0).any():  # more distinct words than the memo holds: texts one by one
                if len(texts) == 1:
                    parts = [self.word_ids(whole[x:y]) for x, y in zip(start.tolist(), end.tolist())]
                    ids = np.array([i for p in parts for i in p], np.uint32)
                    return ids, np.array([0, len(ids)])
                both = [self._plain([t]) for t in texts]
                return np.concatenate([b[0] for b in both]), np.concatenate([[0], np.cumsum([len(b[0]) for b in both])])
        n = self._len[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.repeat(self._at[at] - upto[:-1], n) + np.arange(upto[-1])]
        word_of = np.searchsorted(start, np.concatenate([[0], ends]))
        return ids, upto[word_of]
