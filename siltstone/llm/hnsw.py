"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are first folded into one representative.  Representatives of a
label are dealt into shards of bounded size, a graph is built for each shard,
and every shard is queried by every vector of its label: one task for each pair
of shards.  A beam that holds nothing but links belongs to a dense group: all
vectors that links or the graph's edges tie to the group are compared with all
of its queries by matrix products, until no more join.  Beams widen for all
queries of a task until an audit passes: sampled queries are held against brute
force, and copies of sampled vectors, moved towards the threshold, must meet a link.
Cosines are computed in double precision and linked vectors are united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, give_back, mapped, partitions, written
from .wordscan import mix

THRESHOLD = 0.98
#: Vectors in a shard at most; a shard also holds at most so many bytes of vectors.
SHARD, SHARD_BYTES = 16384, 48 << 20
M, EF_BUILD, EF_SEARCH = 12, 40, 16
#: Audited queries in a task, and the recall that an audit asks for.
AUDIT, RECALL = 128, 0.99
BATCH = 256


class Graph:
    """A navigable small-world graph over unit vectors; searches run for many queries in step."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.x = x
        self.layers: list[tuple[np.ndarray, np.ndarray]] = layers or []  # (members, neighbours of each as vector numbers), bottom first
        self._slot: list[np.ndarray] = []
        for members, _ in self.layers:
            self._slot.append(self._slots(members))

    def _slots(self, members: np.ndarray) -> np.ndarray:
        s = np.full(len(self.x), -1, np.int32)
        s[members] = np.arange(len(members))
        return s

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """Vectors enter in a fixed order, in growing batches; a vector's height follows a hash of its number."""
        g, n = cls(x), len(x)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        height = np.floor(-np.log(np.maximum(u, 1e-300)) / math.log(M)).astype(int)
        top = 0
        while (height > top).sum() > 4:
            top += 1
        for level in range(top + 1):
            members = np.flatnonzero(height >= level).astype(np.int32)
            g.layers.append((members, np.full((len(members), 2 * M if level == 0 else M), -1, np.int32)))
            g._slot.append(g._slots(members))
        for level in range(top, -1, -1):
            g._fill(level)
        return g

    def _fill(self, level: int) -> None:
        """Link one layer; the layers above are complete and give entry points."""
        members, near = self.layers[level]
        degree, done = near.shape[1], 0
        if len(members) == 0:
            return
        entered = np.zeros(len(self.x), bool)
        while done < len(members):
            size = min(len(members) - done, max(32, min(BATCH, done)))
            new = members[done : done + size]
            q = self.x[new]
            cand, sim = (np.zeros((size, 0), np.int32), np.zeros((size, 0)))
            if done:
                start = self._descend(q, level + 1)
                ok = entered[start]
                start = np.where(ok, start, members[0])
                cand, sim = self._beam(q, start[:, None], level, EF_BUILD)
            inner = q @ q.T
            np.fill_diagonal(inner, -2)
            k = min(size - 1, EF_BUILD // 2)
            if k > 0:
                at = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                cand = np.concatenate([cand, new[at]], 1)
                sim = np.concatenate([sim, np.take_along_axis(inner, at, 1)], 1)
            chosen = self._diverse(cand, sim, M)
            near[done : done + size, : chosen.shape[1]] = chosen
            entered[new] = True
            # links back; a full node keeps a diverse choice
            src = np.repeat(new, chosen.shape[1])
            dst = chosen.ravel()
            ok = dst >= 0
            self._link(level, dst[ok], src[ok], degree)
            done += size

    def _link(self, level: int, node: np.ndarray, other: np.ndarray, degree: int) -> None:
        _, near = self.layers[level]
        order = np.argsort(node, kind="stable")
        node, other = node[order], other[order]
        heads, first, count = np.unique(node, return_index=True, return_counts=True)
        slot = self._slot[level][heads]
        width = int(count.max()) if len(count) else 0
        step = max(1, min(width, 4 * degree))
        for a in range(0, width, step):  # a hub gets its links in portions
            mine = np.flatnonzero(count > a)
            n = np.minimum(count[mine] - a, step)
            grid = np.full((len(mine), step), -1, np.int32)
            col = np.arange(step)
            use = col[None, :] < n[:, None]
            grid[use] = other[(first[mine] + a)[:, None].repeat(step, 1)[use] + np.broadcast_to(col, use.shape)[use]]
            cand = np.concatenate([near[slot[mine]], grid], 1)
            free = (near[slot[mine]] < 0).sum(1) >= n
            for full in (False, True):
                rows = np.flatnonzero(free != full)
                if not len(rows):
                    continue
                c = cand[rows]
                if not full:  # room for all: keep them
                    srt = np.argsort(c < 0, axis=1, kind="stable")[:, :degree]
                    near[slot[mine[rows]]] = np.take_along_axis(c, srt, 1)
                else:
                    for b in range(0, len(rows), BATCH):
                        r = rows[b : b + BATCH]
                        c = cand[r]
                        s = np.einsum("qkd,qd->qk", self.x[np.maximum(c, 0)], self.x[heads[mine[r]]])
                        s[c < 0] = -2
                        keep = self._diverse(c, s, degree)
                        pad = np.full((len(r), degree), -1, np.int32)
                        pad[:, : keep.shape[1]] = keep
                        near[slot[mine[r]]] = pad

    def _diverse(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates, best first: those nearer to the query than to any taken one, then the best of the rest."""
        if cand.shape[1] == 0:
            return cand
        k = min(cand.shape[1], 3 * most)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        valid = (cand >= 0) & (sim > -1.5)
        v = self.x[np.maximum(cand, 0)]
        among = np.einsum("qkd,qjd->qkj", v, v)
        taken = np.zeros(cand.shape, bool)
        for j in range(k):
            worst = np.where(taken, among[:, j, :], -2).max(1)
            taken[:, j] = valid[:, j] & (sim[:, j] > worst) & (taken.sum(1) < most)
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(cand, rank, 1)
        return np.where(np.take_along_axis(valid, rank, 1), out, -1).astype(np.int32)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        if len(self.layers) <= to:
            return at + (self.layers[-1][0][0] if self.layers and len(self.layers[-1][0]) else 0)
        at += self.layers[-1][0][0]
        for level in range(len(self.layers) - 1, to - 1, -1):
            at = self._beam(q, at[:, None], level, 4)[0][:, 0].astype(np.int64)
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search in one layer, in step for all queries: (vector numbers, cosines), best first, -1 padded."""
        near, slot = self.layers[level][1], self._slot[level]
        n = len(q)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, ef), -1, np.int32)
        sims = np.full((n, ef), -2.0)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("qd,qd->q", self.x[start[:, 0]], q)
        seen[np.arange(n), start[:, 0]] = True
        fresh = ids >= 0
        live = np.arange(n)
        while len(live):
            best = np.argmax(fresh[live], axis=1)  # beams are sorted: the first fresh entry is the best one
            go = fresh[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            fresh[live, best] = False
            nb = near[slot[ids[live, best]]]
            r = np.broadcast_to(live[:, None], nb.shape)
            ok = (nb >= 0) & ~seen[r, np.maximum(nb, 0)]
            seen[r[ok], nb[ok]] = True
            s = np.full(nb.shape, -2.0)
            s[ok] = np.einsum("kd,kd->k", self.x[nb[ok]], q[r[ok]])
            ai = np.concatenate([ids[live], np.where(ok, nb, -1)], 1)
            asim = np.concatenate([sims[live], s], 1)
            af = np.concatenate([fresh[live], ok], 1)
            o = np.argsort(-asim, axis=1, kind="stable")[:, :ef]
            ids[live], sims[live], fresh[live] = np.take_along_axis(ai, o, 1), np.take_along_axis(asim, o, 1), np.take_along_axis(af, o, 1)
        return ids, sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(q, self._descend(q, 1)[:, None], 0, min(ef, len(self.x)))

    def beams(self, q: np.ndarray, threshold: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector) of the links in beams of ``ef``, and which queries' beams hold nothing else."""
        qs, xs, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(q), bool)
        for a in range(0, len(q), BATCH):
            ids, sims = self.search(q[a : a + BATCH], ef)
            hit = (sims >= threshold) & (ids >= 0)
            full[a : a + BATCH] = hit.all(1) & (ids.shape[1] < len(self.x))
            i, j = np.nonzero(hit)
            qs.append(i + a)
            xs.append(ids[i, j].astype(np.int64))
        return np.concatenate(qs), np.concatenate(xs), full

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        near = np.unique(self.layers[0][1][self._slot[0][nodes]])
        return near[near >= 0].astype(np.int64)


class Found:
    """Links of a shard's queries: how many vectors each side is linked with, and a spanning forest of all links."""

    def __init__(self, g: Graph, q: np.ndarray | None, counts: np.ndarray, q_counts: np.ndarray, threshold: float, ef: int):
        self.same = q is None  # the shard's own vectors ask
        q = g.x if q is None else q
        shift = 0 if self.same else len(q)
        qs, xs, full = g.beams(q, threshold, ef)
        pairs = qs * len(g.x) + xs
        if self.same:  # a link is one of both ends
            pairs = np.concatenate([pairs, xs * len(g.x) + qs])
        qs, xs = np.divmod(np.unique(pairs), len(g.x))
        self.n_q, self.n_x = np.zeros(len(q), np.int64), np.zeros(len(g.x), np.int64)
        self._edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self._shift = shift
        dense = self._dense(g, q, qs, xs, full, threshold)
        kept = ~np.isin(qs, np.concatenate([d[0] for d in dense])) if dense else np.ones(len(qs), bool)
        self._add(qs[kept], xs[kept], counts, q_counts)
        for mine, theirs in dense:
            for a in range(0, len(mine), BATCH):
                i, j = np.nonzero(q[mine[a : a + BATCH]] @ g.x[theirs].T >= threshold)
                self._add(mine[i + a], theirs[j], counts, q_counts)

    def _add(self, qs: np.ndarray, xs: np.ndarray, counts: np.ndarray, q_counts: np.ndarray) -> None:
        if self.same:
            qs, xs = qs[qs != xs], xs[qs != xs]
        self.n_q += np.bincount(qs, counts[xs], len(self.n_q)).astype(np.int64)
        self.n_x += np.bincount(xs, q_counts[qs], len(self.n_x)).astype(np.int64)
        if len(qs):
            self._edges.append(forest(qs, xs + self._shift))

    def _dense(self, g: Graph, q: np.ndarray, qs: np.ndarray, xs: np.ndarray, full: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(queries, vectors) of each group of linked ones with a full beam; vectors next to a group join it while one of its queries is linked with them."""
        edges = [(qs, xs + self._shift)]
        while full.any():
            root = np.arange(len(q) + (0 if self.same else len(g.x)))
            node, low = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
            root[node] = low
            groups, more = [], []
            for r in np.unique(root[: len(q)][full]).tolist():
                mine = np.flatnonzero(root[: len(q)] == r)
                theirs = mine if self.same else np.flatnonzero(root[len(q) :] == r)
                groups.append((mine, theirs))
                near = np.setdiff1d(g.neighbours(theirs), theirs, assume_unique=True)
                for a in range(0, len(near), BATCH):
                    joins = (q[mine] @ g.x[near[a : a + BATCH]].T >= threshold).any(0)
                    more.append((np.full(int(joins.sum()), mine[0]), near[a : a + BATCH][joins] + self._shift))
            if not sum(len(m[0]) for m in more):
                return groups
            edges += more
        return []

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([e[k] for e in self._edges]) for k in (0, 1))
        return forest(a, b) if len(a) else (a, b)


def moved(x: np.ndarray, cosine: float) -> np.ndarray:
    """Copies of unit vectors, each turned by a fixed angle towards a direction of its own."""
    side = np.random.default_rng(7).normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    norm = np.sqrt((side * side).sum(1, keepdims=True))
    return np.where(norm > 1e-9, cosine * x + math.sqrt(1 - cosine * cosine) * side / np.maximum(norm, 1e-9), x)


def beam_width(g: Graph, q: np.ndarray, threshold: float) -> int:
    """The narrowest beam that passes the audit; as wide as the shard at most, where nothing can be missed but what no edge leads to."""
    pick = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
    true = q[pick] @ g.x.T >= threshold
    some = np.unique(np.linspace(0, len(g.x) - 1, min(AUDIT, len(g.x))).astype(int))
    probe = moved(g.x[some], (1 + threshold) / 2)
    ef = EF_SEARCH
    while ef < len(g.x):
        a, b, full = g.beams(q[pick], threshold, ef)
        linked = true.sum(1)
        got = np.where(full, linked, np.bincount(a, minlength=len(pick)))
        ids, _ = g.search(probe, ef)
        met = np.einsum("qkd,qd->qk", g.x[np.maximum(ids, 0)], probe).max(1) >= threshold
        if got.sum() >= RECALL * linked.sum() and met.mean() >= RECALL:
            return ef
        ef *= 2
    return len(g.x)


SHARDS = "label string, dim int, shard int, single boolean, ids binary, counts binary, vectors binary, members array<binary>, near array<binary>"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, whatever their magnitude."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    t = t.combine_chunks().sort_by("rep")
    values = t.column("embedding").combine_chunks()
    single = pa.types.is_float32(values.type.value_type)
    x = values.flatten().to_numpy().reshape(t.num_rows, -1)
    g = Graph.build(unit(x))
    row = [single, t.column("rep").to_numpy().astype("<i8").tobytes(), t.column("n").to_numpy().astype("<i8").tobytes(), x.astype("<f4" if single else "<f8").tobytes(), [m.tobytes() for m, _ in g.layers], [n.tobytes() for _, n in g.layers]]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_()] + [pa.binary()] * 3 + [pa.list_(pa.binary())] * 2
    out = pa.Table.from_arrays([pa.array([v], k) for v, k in zip([*(k.as_py() for k in key), *row], kinds)], names=[c.split()[0] for c in SHARDS.split(", ")])
    give_back()
    return out


def _unpack(r: dict, dim: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    x = unit(np.frombuffer(r["vectors"], "<f4" if r["single"] else "<f8").reshape(-1, dim))
    layers = []
    for m, n in zip(r["members"], r["near"]):
        m = np.frombuffer(m, np.int32)
        layers.append((m, np.frombuffer(n, np.int32).reshape(len(m), -1)))
    return Graph(x, layers), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<i8")


def _search(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                g, ids, counts = _unpack(r["a"], r["dim"])
                if r["b"] is None:
                    f = Found(g, None, counts, counts, threshold, beam_width(g, g.x, threshold))
                    node, n = ids, f.n_q
                else:
                    h, ids_b, counts_b = _unpack(r["b"], r["dim"])
                    f = Found(h, g.x, counts_b, counts, threshold, beam_width(h, g.x, threshold))
                    node, n = np.concatenate([ids, ids_b]), np.concatenate([f.n_q, f.n_x])
                a, c = f.forest()
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[a]])), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([node[some], node[c]]))], ["node", "links", "to"])
        give_back()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding, label)``.

    Only rows with the same label (of any type that casts to a string) and
    dimension are compared.  A null label or id, a null, empty or zero vector,
    and one with null or non-finite components link with nothing (component is
    the row's own id).  Rows with equal vectors are linked with each other; a
    cosine equal to the threshold links.  Rows that repeat an identifier are one
    vertex but count as links of each other.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    if "float" not in vectors.schema["embedding"].dataType.simpleString():
        e = e.cast("array<double>")
    v = vectors.select("vec_id", e.alias("embedding"), F.col("label").cast("string").alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumns({"dim": F.size("embedding"), "k": F.xxhash64("embedding"), "l": F.xxhash64(F.reverse("embedding"), F.lit(1))})
    named = ["label", "dim", "k", "l"]  # 128 bits of hashes stand for a vector
    ids = v.where("ok").groupBy(*named).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = v.where("ok").groupBy(*named).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    dims = ids.groupBy("label", "dim").agg(F.count("*").alias("total"))
    per = F.least(F.lit(shard), F.greatest(F.lit(256), (F.lit(SHARD_BYTES) / (8 * F.col("dim"))).cast("int")))
    dims = dims.select("label", "dim", F.ceil(F.col("total") / per).cast("int").alias("shards"))
    dealt = reps.join(dims, ["label", "dim"]).withColumn("shard", F.pmod("k", "shards").cast("int"))
    graphs = written(dealt.select("label", "dim", "shard", "rep", "n", "embedding").groupBy("label", "dim", "shard").applyInArrow(_build, SHARDS), "hnsw-graphs")
    side = lambda k: graphs.select("label", "dim", F.struct(*(c for c in graphs.columns if c not in ("label", "dim"))).alias(k))
    own = side("a").select("label", "dim", "a", F.lit(None).cast(side("a").schema["a"].dataType).alias("b"))
    pairs = own.union(side("a").join(side("b"), ["label", "dim"]).where("a.shard < b.shard"))
    pairs = pairs.repartition(partitions(spark), "label", "dim", "a.shard", "b.shard")
    found = written(pairs.select("dim", "a", "b").transform(mapped(_search(threshold), "node long, links long, to long")), "hnsw-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = ids.join(links, ids.rep == links.node, "left").drop("node").join(roots, F.col("rep") == roots.node, "left").select(*named, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    yes = v.where("ok").select("vec_id", *named).join(known, named).select("vec_id", "n_links", "component_id")
    out = yes.union(v.where("not ok").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
