"""Packing by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and an end id.  Full windows are cut off
its front and stand alone; what is left over, up to a window, is cut into pieces
of at most ``grain`` ids.  Pieces are packed in groups: multiway differencing
keeps partial partitions of a group into k windows, and always merges the two
with the largest imbalance, the heaviest windows of one onto the lightest of
the other.  That gives near-equal windows.  k starts at the least possible and
rises while any window is over capacity.

Nothing is shuffled: a task packs the documents it scans, so a retried task
gives the same rows, and sequence ids (task number and a counter) never meet.

Null or empty texts hold the end id alone; null ids are kept; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import chunks, mapped

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp into ``k`` windows: (window of each item, load of each window)."""
    n = len(sizes)
    nxt = np.full(n, -1, np.int64)
    heap: list[tuple[int, int, tuple]] = []
    for i, s in enumerate(sizes.tolist()):
        # windows from heaviest to lightest; only the first ``len`` can hold items
        heap.append((-s, i, (np.array([s]), np.array([i]), np.array([i]))))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, (la, ha, ta) = heapq.heappop(heap)
        _, _, (lb, hb, tb) = heapq.heappop(heap)
        m = min(k, len(la) + len(lb))
        load, head, tail = np.zeros(m, np.int64), np.full(m, -1, np.int64), np.full(m, -1, np.int64)
        load[: len(la)], head[: len(la)], tail[: len(la)] = la, ha, ta
        # heaviest of b onto lightest of a
        at = m - 1 - np.arange(len(lb))
        load[at] += lb
        both = (head[at] >= 0) & (hb >= 0)
        nxt[tail[at[both]]] = hb[both]
        fresh = (head[at] < 0) & (hb >= 0)
        head[at[fresh]] = hb[fresh]
        got = hb >= 0
        tail[at[got]] = tb[got]
        if m == k:
            load -= load.min()
        order = np.argsort(-load, kind="stable")
        load, head, tail = load[order], head[order], tail[order]
        heapq.heappush(heap, (-int(load[0] - (load[-1] if m == k else 0)), tick, (load, head, tail)))
        tick += 1
    window, total = np.zeros(n, np.int64), np.zeros(k, np.int64)
    if heap:
        for w, i in enumerate(heap[0][2][1].tolist()):
            while i >= 0:
                window[i] = w
                total[w] += sizes[i]
                i = int(nxt[i])
    return window, total


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Pack items of at most ``capacity``: (window of each item, number of windows)."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64), 0
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, load = differencing(sizes, k)
        if load.max() <= capacity:
            return window, k
        k += max(1, k // 100)


def _packer(path: str, capacity: int, group: int, grain: int, end_id: int, ids_too: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.MemoTokenizer(path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        used = 0
        rows: list[tuple] = []
        queue: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[] for _ in range(8)]
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 7 + ids_too], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + ids_too])

        def flush() -> None:
            nonlocal used
            window, k = windows(np.array([q[2] for q in queue], np.int64), capacity)
            fill = [0] * k
            for q, w in zip(queue, window.tolist()):
                rows.append((*q[:5], base + used + w, fill[w], q[5]))
                fill[w] += q[2]
            used += k
            queue.clear()

        for part, _, _ in chunks(batches, "text", bpe.TEXT_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, off = tok.encode(texts)
            for i, doc in enumerate(part.column(0).to_pylist()):
                x = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id)).astype("<u4")
                n, a = len(x), 0
                while n - a >= capacity:
                    b = x[a : a + capacity].tobytes()
                    rows.append((doc, a, capacity, zlib.crc32(b), n, base + used, 0, b if ids_too else b""))
                    used += 1
                    a += capacity
                if a < n:
                    cuts = -(-(n - a) // grain)
                    edges = [a + (n - a) * j // cuts for j in range(cuts + 1)]
                    for s, e in zip(edges, edges[1:]):
                        b = x[s:e].tobytes()
                        queue.append((doc, s, e - s, zlib.crc32(b), n, b if ids_too else b""))
                if len(queue) >= group:
                    flush()
                if len(rows) >= 20_000:
                    yield out()
                    rows.clear()
        if queue:
            flush()
        if rows:
            yield out()

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 1024, group: int = 1024, grain: int = 320, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' token sequences, dealt into windows of at most ``capacity``.

    ``group``: pieces that are packed together; ``grain``: the largest piece of
    a document's rest.  ``with_ids`` adds the piece's ids (little-endian 32-bit).
    """
    f = _packer(vocabulary or bpe.default_path(), capacity, group, grain, end_id, with_ids)
    return docs.select("doc_id", "text").transform(mapped(f, COLUMNS + ", ids binary" * with_ids))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
