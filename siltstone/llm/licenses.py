"""License scan by template-markup matching.

A template is license wording with two kinds of markup: optional regions
``[ ... ]``, which may nest, and replaceable regions ``<<n>>``, up to n words of
any kind.  Each template is compiled into an automaton over words, determinised
as texts ask for it; it accepts where all mandatory words stand in order,
exactly, with optional and replaceable regions filled or left out.  Plain
phrases are templates without markup and are counted at every place.

Texts are scanned many at a time: words get literal numbers by array lookups,
and automata start only where the first two words can begin a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, mapped
from .wordscan import Words, word_hash

#: Phrases of the contract and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Templates: label, wording.
TEMPLATES = [
    ("mit", "[this] [software|work|project] [is] [released|licensed|distributed|available] under the [terms of the] [<<2>>] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction"),
    ("apache-2", "licensed under the [terms of the] apache [software] license version 2 [0]"),
    ("cc-by-nc", "licensed under [the|a] [creative commons] [attribution noncommercial] cc by nc [<<1>>] 4 0 [international] [license]"),
    ("cc-by-nc", "licensed under [the|a] creative commons attribution noncommercial [4 0] [international] license"),
    ("cc-by", "licensed under [the|a] [creative commons] cc by 4 0 [international] [license]"),
    ("gpl-3", "[this work|program|software] is licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2", "[this work|program|software] is licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu [lesser|affero] general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright [c] <<8>> all rights reserved"),
]

_MARK = re.compile(r"<<(\d+)>>|([\[\]|])|([^\s\[\]|<>]+)")


class Template:
    """One compiled template: transitions of a word automaton, built as they are met."""

    DEAD = -1

    def __init__(self, label: str, wording: str):
        self.label, self.wording = label, wording
        self._edges: list[list[tuple[str | None, int]]] = []
        self._free: list[list[int]] = []
        self.mandatory = 0
        items = [m.groups() for m in _MARK.finditer(wording)]
        start = self._new()
        end, rest = self._sequence(items, 0, start, 0)
        if rest != len(items):
            raise ValueError(f"unbalanced markup: {wording}")
        self._final = end
        self._sets: dict[frozenset, int] = {}
        self._states: list[frozenset] = []
        self._moves: list[dict[str | None, int]] = []
        self.start = self._number(self._closed({start}))
        self.literals = {w for e in self._edges for w, _ in e if w}

    def _new(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _sequence(self, items: list, at: int, state: int, depth: int) -> tuple[int, int]:
        while at < len(items):
            gap, mark, word = items[at]
            if word:
                to = self._new()
                self._edges[state].append((word, to))
                self.mandatory += depth == 0
                state, at = to, at + 1
            elif gap:
                to = self._new()
                self._free[state].append(to)
                here = state
                for _ in range(int(gap)):
                    nxt = self._new()
                    self._edges[here].append((None, nxt))
                    self._free[nxt].append(to)
                    here = nxt
                state, at = to, at + 1
            elif mark == "[":
                to = self._new()
                self._free[state].append(to)
                while mark != "]":
                    inner = self._new()
                    self._free[state].append(inner)
                    end, at = self._sequence(items, at + 1, inner, depth + 1)
                    self._free[end].append(to)
                    if at == len(items):
                        raise ValueError(f"unbalanced markup: {self.wording}")
                    mark = items[at][1]
                state, at = to, at + 1
            else:
                break
        return state, at

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self._free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _number(self, states: frozenset) -> int:
        if not states:
            return self.DEAD
        if states not in self._sets:
            self._sets[states] = len(self._states)
            self._states.append(states)
            self._moves.append({})
        return self._sets[states]

    def step(self, state: int, word: str | None) -> int:
        """The next state; ``word`` None stands for any word that is no literal here."""
        if word not in self._moves[state]:
            to = {t for s in self._states[state] for w, t in self._edges[s] if w is None or w == word}
            self._moves[state][word] = self._number(self._closed(to))
        return self._moves[state][word]

    def accepts(self, state: int) -> bool:
        return self._final in self._states[state]

    def match(self, words: list[str], at: int = 0) -> int:
        """End of the longest match that starts at ``words[at]``, or -1."""
        state, end = self.start, -1
        for i in range(at, len(words)):
            w = words[i]
            state = self.step(state, w if w in self.literals else None)
            if state == self.DEAD:
                break
            if self.accepts(state):
                end = i + 1
        return end


class Matcher:
    """Phrases and templates against many texts at once."""

    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = [(label, p.split()) for label, p in phrases]
        self.templates = [Template(*t) for t in templates]
        literals = sorted({w for _, p in self.phrases for w in p} | {w for t in self.templates for w in t.literals})
        self.literals = [None, *literals]
        h = np.array([word_hash(w.encode()) for w in literals], np.uint64)
        order = np.argsort(h)
        self._hash, self._number = h[order], order + 1
        self._of = {w: i + 1 for i, w in enumerate(literals)}
        n = len(self.literals)
        self._filter = np.zeros(1 << 16, bool)
        self._filter[(h >> np.uint64(48)).astype(np.int64)] = True
        self._begin = np.zeros((n, n), bool)
        for t in self.templates:
            for i in range(n):
                s = t.step(t.start, self.literals[i] if self.literals[i] in t.literals else None)
                if s != t.DEAD:
                    for j in range(n):
                        self._begin[i, j] |= t.step(s, self.literals[j] if self.literals[j] in t.literals else None) != t.DEAD or t.accepts(s)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Literal numbers of words; 0 for any other word."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self._filter[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self._hash, hashes[maybe]), len(self._hash) - 1)
        hit = self._hash[at] == hashes[maybe]
        out[maybe[hit]] = self._number[at[hit]]
        return out

    def scan(self, words: Words) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
        """For each text: its phrase places and its template matches, as (label, first word, end word)."""
        n_docs = len(words.first) - 1
        phrases, matches = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
        n = len(words)
        if not n:
            return phrases, matches
        num = np.concatenate([self.number(words.hash), np.zeros(1, np.int32)])
        for label, p in self.phrases:
            at = np.flatnonzero(num[:n] == self._of[p[0]])
            for j, w in enumerate(p[1:], 1):
                at = at[at + j < n]
                at = at[num[at + j] == self._of[w]]
            doc = np.searchsorted(words.first, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist()):
                if i + len(p) <= words.first[d + 1] and all(words.text(i + j) == w.encode() for j, w in enumerate(p)):
                    phrases[d].append((label, i - int(words.first[d]), i - int(words.first[d]) + len(p)))
        at = np.flatnonzero(self._begin[num[:n], num[1 : n + 1]])
        doc = np.searchsorted(words.first, at, "right") - 1
        for i, d in zip(at.tolist(), doc.tolist()):
            end = int(words.first[d + 1])
            for t in self.templates:
                state, last, j = t.start, -1, i
                while j < end:
                    w = self.literals[num[j]]
                    state = t.step(state, w if w in t.literals else None)
                    if state == t.DEAD:
                        break
                    j += 1
                    if t.accepts(state):
                        last = j
                if last > 0:
                    a = int(words.first[d])
                    matches[d].append((t.label, i - a, last - a, t.mandatory))
        return phrases, matches


@lru_cache(4)
def matcher(phrases: tuple, templates: tuple) -> Matcher:
    return Matcher(list(phrases), list(templates))


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])
SCHEMA = "doc_id long, n_words long, phrases array<struct<label:string,first_word:long,end_word:long>>, templates array<struct<label:string,first_word:long,end_word:long>>, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Phrases and templates in every whole text.

    ``n_base``, ``first_word`` and ``last_word`` tell of phrases; ``labels``
    holds those of phrases and templates.  ``score`` is w / (w + 1), w being the
    most mandatory words that one match holds, and 0 without a match.  Null and
    empty texts have no words and no labels; repeated rows are scanned each; an
    empty table gives no rows; other columns are ignored.  No shuffle.
    """
    key = (tuple(phrases), tuple(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(*key)
        for part, buf, off in chunks(batches, "text"):
            words = Words(buf, off)
            found, matches = m.scan(words)
            spans = lambda xs: [[{"label": x[0], "first_word": x[1], "end_word": x[2]} for x in row] for row in xs]
            base = [",".join(sorted({x[0] for x in f})) for f in found]
            both = [",".join(sorted({x[0] for x in f} | {x[0] for x in g})) for f, g in zip(found, matches)]
            most = [max([0, *(x[2] - x[1] for x in f), *(x[3] for x in g)]) for f, g in zip(found, matches)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(spans(found), pa.list_(SPAN)),
                    pa.array(spans(matches), pa.list_(SPAN)),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([min((x[1] for x in f), default=None) for f in found], pa.int64()),
                    pa.array([max((x[1] for x in f), default=None) for f in found], pa.int64()),
                    pa.array(base),
                    pa.array(both),
                    pa.array([w / (w + 1) for w in most], pa.float64()),
                ],
                ["doc_id", "n_words", "phrases", "templates", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select("doc_id", "text").transform(mapped(run, SCHEMA))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
