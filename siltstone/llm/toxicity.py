"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents (``EXAMPLES``) gives the words that tell
the classes apart and the examples; inverse document frequencies of those words
are counted over all documents.  Examples go into an inverted index with block
maxima: a query adds up its words' block maxima, visits blocks in falling order
of that bound, scores them exactly and stops when no block can reach the k-th
best.  Neighbours vote with their similarity, a smoothed share is calibrated by
a logistic curve fitted on the examples without themselves, and the neighbours
are the evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mapped, partitions, written
from .wordscan import ALNUM, Words, runs

#: Bounds of what is fitted: labelled documents, words, neighbours.
EXAMPLES, WORDS, NEIGHBOURS = 16384, 2048, 15
#: A word is used if it stands in so many examples and its chi-square reaches this (p < 1e-6).
LEAST_DF, CHI_SQUARE = 12, 24.0
BLOCK = 64
#: Votes of the prior, and the label share they carry is that of examples without any used word.
SMOOTH = 0.5


class Index:
    """Block-max inverted index over the examples' unit TF-IDF vectors."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        rows = [(i, *vectors[i]) for i in order if len(vectors[i][0])]
        self.idf = idf
        self.ids = [ids[r[0]] for r in rows]
        self.labels = np.array([labels[r[0]] for r in rows], np.float64)
        bare = np.array([labels[i] for i in order if not len(vectors[i][0])], np.float64)
        self.prior = (bare.sum() + 0.5) / (len(bare) + 1.0)
        self.vectors = [(t, self.unit(t, n)) for _, t, n in rows]
        n, v = len(rows), len(idf)
        self.blocks = -(-n // BLOCK) if n else 0
        post: list[list] = [[] for _ in range(v)]
        for e, (t, w) in enumerate(self.vectors):
            for a, b in zip(t.tolist(), w.tolist()):
                post[a].append((e, b))
        self.max = np.zeros((v, max(1, self.blocks)))
        self.post, self.cut = [], []
        for t, p in enumerate(post):
            e, w = np.array([x[0] for x in p], np.int64), np.array([x[1] for x in p])
            self.post.append((e, w))
            self.cut.append(np.searchsorted(e, np.arange(self.blocks + 1) * BLOCK))
            if len(e):
                np.maximum.at(self.max[t], e // BLOCK, w)
        self.curve = (1.0, 0.0)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / math.sqrt(float((w * w).sum()))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (position, cosine), ties by smaller id; only cosines above 0."""
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = weights @ self.max[terms]
        order = np.argsort(-bound, kind="stable")
        at, sim = np.zeros(0, np.int64), np.zeros(0)
        for b in order.tolist():
            if bound[b] <= 0 or len(sim) >= k and bound[b] < sim[-1] - 1e-12:
                break
            s = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist()):
                lo, hi = self.cut[t][b], self.cut[t][b + 1]
                if hi > lo:
                    e, x = self.post[t]
                    s[e[lo:hi] - b * BLOCK] += w * x[lo:hi]
            hit = np.flatnonzero(s > 0)
            at, sim = np.concatenate([at, hit + b * BLOCK]), np.concatenate([sim, s[hit]])
            best = np.lexsort((at, -np.round(sim, 12)))[:k]
            at, sim = at[best], sim[best]
        return at, sim

    def vote(self, at: np.ndarray, sim: np.ndarray) -> float:
        """Similarity-weighted share of the label among neighbours, smoothed by the prior."""
        return float(((sim * self.labels[at]).sum() + SMOOTH * self.prior) / (sim.sum() + SMOOTH))

    def calibrate(self, x: list[float], y: list[float]) -> None:
        """Logistic curve from the examples' votes ``x``, each without itself, to their labels."""
        if not 0 < sum(y) < len(y):
            return
        x, y, a, b = np.array(x), np.array(y), 1.0, 0.0
        hi = (y.sum() + 1) / (y.sum() + 2)
        goal = np.where(y > 0, hi, 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - goal) * x).sum() + 1e-3 * a, (p - goal).sum()])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
            if abs(step).max() < 1e-9:
                break
        self.curve = (a, b)

    def others(self, doc_id: int, terms: np.ndarray, counts: np.ndarray, k: int) -> float:
        """The vote of an example's neighbours without itself."""
        at, sim = self.nearest(terms, self.unit(terms, counts), k + 1)
        away = np.array([self.ids[i] != doc_id for i in at.tolist()], bool)
        return self.vote(at[away][:k], sim[away][:k])

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int) -> tuple[float, list]:
        """(calibrated score, evidence); a document without any used word has the share of such examples."""
        if not len(terms):
            return self.prior, []
        at, sim = self.nearest(terms, self.unit(terms, counts), k)
        z = self.curve[0] * self.vote(at, sim) + self.curve[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [{"doc_id": self.ids[i], "similarity": s, "toxic": int(self.labels[i])} for i, s in zip(at.tolist(), sim.tolist())]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, toxic, two minima of shingle hashes, the text's distinct words."""
    for part, buf, off in chunks(batches, "text"):
        w = Words(buf, off, ALNUM)
        h = runs(w, 5)
        m1, m2, words = [], [], []
        for i in range(part.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            x = h[a : b - 4] if b - a >= 5 else w.hash[a:b]
            m1.append(int(x.min() >> np.uint64(1)) if len(x) else -1)
            m2.append(int(x.max() >> np.uint64(1)) if len(x) else -1)
            words.append(sorted({w.text(j).decode("utf-8", "replace") for j in range(a, b)}))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(2).cast(pa.int32()), pa.array(m1, pa.int64()), pa.array(m2, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "text", "toxic", "m1", "m2", "words"])


def _vectors(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number = table.table if isinstance(table, Model) else table.value
        bits = np.zeros(1 << 16, bool)
        bits[(key >> np.uint64(48)).astype(np.int64)] = True
        for part, buf, off in chunks(batches, "text"):
            w = Words(buf, off, ALNUM)
            maybe = np.flatnonzero(bits[(w.hash >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(key, w.hash[maybe]), max(0, len(key) - 1))
            hit = key[at] == w.hash[maybe] if len(key) else np.zeros(len(maybe), bool)
            pos, term = maybe[hit], number[at[hit]] if len(key) else np.zeros(0, np.int64)
            doc = np.searchsorted(w.first, pos, "right") - 1
            code, n = np.unique(doc * max(1, len(key)) + term, return_counts=True)
            d, t = code // max(1, len(key)), code % max(1, len(key))
            cut = np.searchsorted(d, np.arange(part.num_rows + 1))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists(t), lists(n)], ["doc_id", "terms", "counts"])

    return run


def _frequencies(table):
    """(term, texts that hold it) of each task; term -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = 0, np.zeros(len(table.value[0]), np.int64)
        for b in _vectors(table)(batches):
            n += b.num_rows
            of += np.bincount(b.column(1).flatten().to_numpy(), minlength=len(of))
        some = np.flatnonzero(of)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(of[some], n), pa.int64())], ["term", "n"])

    return run


class Model:
    """Words, index and curve; ``table``: sorted word hashes and their numbers."""

    def __init__(self, words: list[str], index: Index | None, k: int):
        from .wordscan import word_hash

        h = np.array([word_hash(w.encode()) for w in words], np.uint64)
        order = np.argsort(h)
        self.words, self.table, self.index, self.k = words, (h[order], order.astype(np.int64)), index, k


def select_words(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, words: int = WORDS) -> tuple[list[str], DataFrame]:
    """(the telling words, the examples): from at most ``examples`` labelled rows that are not held out.

    The rows are those with the smallest hash of their identifier.  Copies and
    most near copies of an example are left out, so that one text's rare words
    don't pass for telling ones.
    """
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    picked = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("doc_id", "text", "toxic")
    ex = picked.transform(mapped(_example_words, "doc_id long, text string, toxic int, m1 long, m2 long, words array<string>"))
    first = lambda d, m: d.groupBy(m).agg(F.min_by(F.struct(*d.columns), "doc_id").alias("r")).select("r.*")
    ex = written(first(first(ex, "m1"), "m2"), "toxicity-examples")
    n, n1 = ex.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return [], ex
    by = ex.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.sum("toxic").alias("t")).where(F.col("df") >= LEAST_DF)
    d, t = F.col("df").cast("double"), F.col("t").cast("double")
    x = t * (n - n1) - (d - t) * n1
    by = by.withColumn("x2", x * x * n / (d * (n - d) * float(n1) * float(n - n1) + 1e-9)).where(F.col("x2") >= CHI_SQUARE)
    return sorted(r.w for r in by.orderBy(F.desc("x2"), "w").limit(words).select("w").collect()), ex


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, words: int = WORDS, k: int = NEIGHBOURS) -> Model:
    """The model: words and examples from the bounded sample, document frequencies from all documents."""
    spark = docs.sparkSession
    chosen, ex = select_words(docs, labels, examples, words)
    model = Model(chosen, None, k)
    table = spark.sparkContext.broadcast(model.table)
    df, n = np.ones(max(1, len(chosen))), 0
    counts = docs.select(F.lit(0).alias("doc_id"), "text").transform(mapped(_frequencies(table), "term int, n long"))
    for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per used word
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    idf = np.log((1 + n) / df) + 1
    vectors = ex.select("doc_id", "text").transform(mapped(_vectors(table), "doc_id long, terms array<int>, counts array<int>")).join(F.broadcast(ex.select("doc_id", "toxic")), "doc_id")
    mine = vectors.collect()  # at most EXAMPLES rows of used words
    index = Index([r.doc_id for r in mine], np.array([r.toxic for r in mine], np.float64), [(np.array(r.terms, np.int64), np.array(r.counts, np.float64)) for r in mine], idf)
    shared = spark.sparkContext.broadcast(index)
    votes = vectors.where(F.size("terms") > 0).repartition(partitions(spark)).select("doc_id", "terms", "counts", "toxic").transform(mapped(_votes(shared, k), "vote double, toxic int")).collect()
    votes = sorted((r.vote, r.toxic) for r in votes)
    index.calibrate([v for v, _ in votes], [float(t) for _, t in votes])
    model.index = index
    for b in (shared, table):
        b.destroy()
    return model


def _votes(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [shared.value.others(d, np.array(t, np.int64), np.array(n, np.float64), k) for d, t, n in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()), b.column(3)], ["vote", "toxic"])

    return run


EVIDENCE = "array<struct<doc_id:long,similarity:double,toxic:int>>"


#: Texts whose scores a task remembers: many texts hold the same used words.
MEMO = 4096


def _judged(shared, batch: pa.RecordBatch, memo: dict) -> Iterator[tuple[float, list]]:
    """(score, evidence) of each row of ``batch`` (doc_id, text)."""
    m = shared.value
    for v in _vectors(m)(iter([batch])):
        for t, n in zip(v.column(1).to_pylist(), v.column(2).to_pylist()):
            key = (tuple(t), tuple(n))
            if key not in memo:
                if len(memo) > MEMO:
                    memo.clear()
                memo[key] = m.index.score(np.array(t, np.int64), np.array(n, np.float64), m.k)
            yield memo[key]


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, memo = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])), {}
        for b in batches:
            out = list(_judged(shared, b, memo))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], kind)], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document.

    Scores come from the text alone.  Null and empty texts score as examples
    without any used word do; without usable labels everything has that share
    (0.5 without any example).  Repeated rows are scored each; labels that are
    null or not 0 or 1 are ignored, of repeated labels the larger counts; null
    ids are never held out; an empty table gives no rows; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))
    s = docs.select("doc_id", "text").transform(mapped(_scores(shared), f"doc_id long, score double, evidence {EVIDENCE}"))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents whose prediction is 0, in their own columns.

    Each row is judged by its text; the model is applied to the rows themselves,
    so nothing is joined by identifier.  Null and empty texts, null ids,
    repeated rows and other columns are handled as in :func:`score`; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            i = b.schema.get_field_index("text")
            pair = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(i)], ["doc_id", "text"])
            yield b.filter(pa.array([s < 0.5 for s, _ in _judged(shared, pair, memo)], pa.bool_()))

    return docs.transform(mapped(run, docs.schema))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score(read("documents"), read("labels"))
