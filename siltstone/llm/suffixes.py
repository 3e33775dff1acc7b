"""Removal of repeated passages by a logarithmic family of sparse suffix arrays.

Every 50-byte window picks one place by its content (``anchors``), so suffixes
at picked places find all matches.  Suffixes are dealt to buckets by their first
28 bytes.  A bucket takes batch after batch: a batch's suffix array, in the
order of the hash of those bytes, is merge-scanned against the existing levels
for equal beginnings and becomes a level itself, and levels of like size merge,
so each suffix is merged a logarithmic number of times.

Suffixes that met another document's are then told apart by the bytes of all
windows they stand for.  If those are equal too, the run is covered in every
document but the first.  Otherwise (a match that starts or ends there) the
windows themselves are compared, bucketed by their hash; this takes place for a
few per cent of all runs, and what is sent grows with the texts, not with pairs.

Texts are not shuffled.  The first pass writes them in compressed chunk files to
the shared folder, and later passes read a chunk by its path, along with packed
lists of its runs.  Before anything is sent, a chunk folds equal suffixes and
windows into that of its smallest document, and suffixes with very many
different contexts into one, so a passage that a third of all documents hold
gives a bucket one entry per chunk.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import LENGTH, Runs, windows_of
from .common import flat, gathered, give_back, mapped, partitions, scratch_path, written
from .sstable import opened

CHUNK = 4 << 20
SLICE = 1 << 20
#: Contexts of one beginning in a chunk before one stands for them all.
LOCAL = 64
#: Entries of one batch of the family.
BATCH = 1 << 17


class Family:
    """Suffix arrays of batches in levels: (key, context, doc, flag, chunk, index, met), sorted by key."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, key, context, doc, flag, chunk, index) -> None:
        """Merge-scan a batch against all levels, then push it and merge levels of like size."""
        order = np.argsort(key, kind="stable")
        batch = [x[order] for x in (key, context, doc, flag, chunk, index)]
        key = batch[0]
        met = np.zeros(len(key), bool)
        met[1:] |= key[1:] == key[:-1]
        met[:-1] |= key[1:] == key[:-1]
        for level in self.levels:
            small, large = (key, level[0]) if len(key) <= len(level[0]) else (level[0], key)
            lo = np.searchsorted(large, small, "left")
            hit = np.flatnonzero(large[np.minimum(lo, len(large) - 1)] == small) if len(large) else lo[:0]
            hi = np.searchsorted(large, small[hit], "right")
            mark = np.zeros(len(large) + 1, np.int32)
            np.add.at(mark, lo[hit], 1)
            np.add.at(mark, hi, -1)
            in_large = np.cumsum(mark[:-1]) > 0
            in_small = np.zeros(len(small), bool)
            in_small[hit] = True
            mine, theirs = (in_small, in_large) if small is key else (in_large, in_small)
            met |= mine
            level[6] |= theirs
        self.levels.append([*batch, met])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate([x, y]) for x, y in zip(b, a)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])

    def met(self) -> list[np.ndarray]:
        """All suffixes that share a beginning, sorted by key, context and doc."""
        cols = [np.concatenate(x) for x in zip(*([c[lv[6]] for c in lv[:6]] for lv in self.levels))]
        order = np.lexsort((cols[2], cols[1], cols[0]))
        return [c[order] for c in cols]


def _heads(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def judged(key, context, doc, flag) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by key, context, doc: (covered, to be compared by windows)."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    new_key, new_class = _heads(key), _heads(key, context)
    head = np.flatnonzero(new_key)
    group, cls = np.cumsum(new_key) - 1, np.cumsum(new_class) - 1
    several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
    hot = np.maximum.reduceat(flag, head)
    classes = np.add.reduceat(new_class.astype(np.int64), head)
    covered = doc > doc[np.flatnonzero(new_class)][cls]
    need = ~covered & ((several & (classes > 1)) | hot)[group]
    return covered, need


def _bytes40(x: np.ndarray) -> bytes:
    b = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return b"".join(b[:, i].tobytes() for i in range(5))


def _from40(b: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for i in range(5):
        out[:, i] = b[i * n : (i + 1) * n]
    return out.view("<u8").ravel()


def pack(key: np.ndarray, context: np.ndarray | None, doc: np.ndarray, flag: np.ndarray, index: np.ndarray) -> bytes:
    """40-bit keys in order and delta-coded, contexts, documents listed once, indices."""
    order = np.argsort(key, kind="stable")
    used, which = np.unique(doc[order], return_inverse=True)
    body = _bytes40(np.diff(key[order], prepend=np.uint64(0)))
    if context is not None:
        body += _bytes40(context[order])
    which = (which << 1 | flag[order]).astype("<u4").view(np.uint8).reshape(-1, 4)
    idx = index[order].astype("<u4").view(np.uint8).reshape(-1, 4)
    body += b"".join(which[:, i].tobytes() for i in range(4)) + b"".join(idx[:, i].tobytes() for i in range(4))
    body += np.diff(used, prepend=0).astype("<i8").tobytes()
    return len(key).to_bytes(4, "little") + zlib.compress(body, 1)


def unpack(b: bytes, context: bool) -> tuple:
    n = int.from_bytes(b[:4], "little")
    body = np.frombuffer(zlib.decompress(b[4:]), np.uint8)
    key, p = np.cumsum(_from40(body, n), dtype=np.uint64), 5 * n
    ctx = np.zeros(n, np.uint64)
    if context:
        ctx, p = _from40(body[p:], n), p + 5 * n
    four = lambda p: np.ascontiguousarray(body[p : p + 4 * n].reshape(4, n).T).view("<u4").ravel()
    which, index = four(p), four(p + 4 * n)
    docs = np.cumsum(body[p + 8 * n :].view("<i8"))
    return key, ctx, docs[which >> 1], (which & 1).astype(bool), index.astype(np.int64)


def pack_sets(*sets: np.ndarray) -> bytes:
    """Several ascending index lists."""
    d = [np.diff(s, prepend=0).astype("<u4") for s in sets]
    return np.array([len(x) for x in d], "<u4").tobytes() + zlib.compress(b"".join(x.tobytes() for x in d), 1)


def unpack_sets(b: bytes, k: int = 2) -> list[np.ndarray]:
    n = np.frombuffer(b[: 4 * k], "<u4")
    d = np.frombuffer(zlib.decompress(b[4 * k :]), "<u4")
    return [np.cumsum(x, dtype=np.int64) for x in np.split(d, np.cumsum(n)[:-1])]


ROWS = "kind int, chunk long, bucket int, path string, payload binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
CHUNKED, SENT, STATE = range(3)


def _row(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], [c.split()[0] for c in ROWS.split(", ")])


def _dealt(chunk: int, path: str, key, context, doc, flag, index, buckets: int) -> Iterator[pa.RecordBatch]:
    b = ((key >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[by], np.arange(buckets + 1))
    rows, size = [], 0
    for i in range(buckets):
        x = by[cut[i] : cut[i + 1]]
        if len(x):
            rows.append((SENT, chunk, i, path, pack(key[x], context[x] if context is not None else None, doc[x], flag[x], index[x])))
            size += len(rows[-1][4])
            if size > 4 << 20:
                yield _row(rows)
                rows, size = [], 0
    if rows:
        yield _row(rows)


def _slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b
        a = b


def _pieces(a: int, b: int, texts: int) -> Iterator[tuple[int, int]]:
    """The bytes [a, b) of some texts at once; of one long text in pieces that overlap, so that each window is in one of them."""
    if texts > 1 or b - a <= 2 * SLICE:
        yield a, b
        return
    for x in range(a, b - LENGTH + 1, SLICE):
        yield x, min(b, x + SLICE + LENGTH - 1)


def _top(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(24)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table.column("doc_id").combine_chunks()
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


def _save(path: str, table: pa.Table, first: np.ndarray, last: np.ndarray, at: np.ndarray, cover: np.ndarray, need: np.ndarray) -> None:
    lengths = zlib.compress((last - first).astype(np.uint8).tobytes(), 1)
    schema = table.schema.with_metadata({b"a": pack_sets(first, at), b"b": lengths, b"c": pack_sets(cover, need)})
    with opened(path, "w") as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.replace_schema_metadata(schema.metadata))


class Chunk:
    """A chunk file: rows, their texts' runs, and what the chunk itself found out about them."""

    def __init__(self, path: str):
        with opened(path, "r") as f:
            self.table = pa.ipc.open_file(f).read_all()
        m = self.table.schema.metadata
        self.first, self.at = unpack_sets(m[b"a"])
        self.last = self.first + np.frombuffer(zlib.decompress(m[b"b"]), np.uint8)
        self.cover, self.need = unpack_sets(m[b"c"])
        self.buf, self.off = flat(self.table.column("text"))


def _first_pass(buckets: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for table, buf, off in gathered(batches, "text", CHUNK):
            ids, known = _ids(table)
            first, last, key, ctx, count = [], [], [], [], []
            for a, b in _slices(off):
                runs = 0
                for x, y in _pieces(int(off[a]), int(off[b]), b - a):
                    r = Runs(buf[x:y], off[a : b + 1] - off[a] if b - a > 1 else np.array([0, y - x]))
                    first.append(r.first + x)
                    last.append(r.last + x)
                    key.append(_top(r.key))
                    ctx.append(_top(r.context))
                    runs = np.diff(r.at) + runs
                count.append(runs)
            first, last, key, ctx = (np.concatenate(x) for x in (first, last, key, ctx))
            at = np.concatenate([[0], np.cumsum(np.concatenate(count))])
            doc_at = np.repeat(np.arange(len(ids)), np.diff(at))
            doc, ok = ids[doc_at], known[doc_at]
            index = np.flatnonzero(ok)
            order = index[np.lexsort((doc[index], ctx[index], key[index]))]
            k, c, d = key[order], ctx[order], doc[order]
            new_class, new_key = _heads(k, c), _heads(k)
            cls = np.cumsum(new_class) - 1
            least = d[np.flatnonzero(new_class)][cls] if len(d) else d
            covered = d > least
            # one entry of a class: further ones in its first document follow it
            classes = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_key)) if len(k) else np.zeros(0, np.int64)
            hot = (classes > LOCAL)[np.cumsum(new_key) - 1] if len(k) else np.zeros(0, bool)
            need = hot & ~covered
            send = ~covered & (~hot | new_key)
            chunk, serial = serial, serial + 1
            path = f"{folder}/chunk-{chunk}-{uuid.uuid4().hex[:12]}.arrow"
            _save(path, table, first, last, at, np.sort(order[covered]), np.sort(order[need]))
            yield _row([(CHUNKED, chunk, chunk % buckets, path, b"")])
            s = order[send]
            yield from _dealt(chunk, path, key[s], ctx[s], doc[s], hot[send], s, buckets)

    return run


def _by_chunk(chunk, index, *flags) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((index, chunk))
    chunk, index = chunk[order], index[order]
    head = np.flatnonzero(_heads(chunk))
    for a, b in zip(head, [*head[1:], len(chunk)]):
        yield int(chunk[a]), pack_sets(*(index[a:b][f[order][a:b]] for f in flags))


def _suffix_bucket(t: pa.Table) -> pa.Table:
    """One bucket of suffixes: packed lists of covered and undecided runs, chunk by chunk."""
    give_back()
    out, family, held, size = [], Family(), [], 0

    def push() -> None:
        family.add(*(np.concatenate(x) for x in zip(*held)))
        held.clear()

    for r in t.sort_by("chunk").to_batches():
        for kind, chunk, bucket, path, b in zip(*(r.column(i).to_pylist() for i in range(5))):
            if kind != SENT:
                out.append((kind, chunk, bucket, path, b))
                continue
            key, ctx, doc, flag, index = unpack(b, True)
            held.append((key, ctx, doc, flag, np.full(len(key), chunk), index))
            size += len(key)
            if size > BATCH:
                push()
                size = 0
    if held:
        push()
    if family.levels:
        key, ctx, doc, flag, chunk, index = family.met()
        covered, need = judged(key, ctx, doc, flag)
        some = covered | need
        for c, b in _by_chunk(chunk[some], index[some], covered[some], need[some]):
            out.append((STATE, c, 0, None, b))
    return pa.Table.from_batches([_row(out)])


def _merged(lists: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)


def _window_table(c: Chunk, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, hash) of all windows of the undecided runs."""
    doc = np.searchsorted(c.at, need, "right") - 1
    docs, starts, hashes = [], [], []
    for a, b in _slices(c.off):
        x, y = np.searchsorted(doc, [a, b])
        if x == y:
            continue
        s, h, n = windows_of(c.buf[c.off[a] : c.off[b]], c.first[need[x:y]] - c.off[a], c.last[need[x:y]] - c.off[a])
        docs.append(np.repeat(doc[x:y], n))
        starts.append(s + c.off[a])
        hashes.append(h)
    if not docs:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(hashes)


def _local_windows(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covered in this chunk, to be sent): equal windows stand for one another, the smallest document's is sent."""
    order = np.lexsort((doc, hashes))
    new = _heads(hashes[order])
    cls = np.cumsum(new) - 1
    least = doc[order][np.flatnonzero(new)][cls] if len(order) else doc
    covered, send = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    covered[order] = doc[order] > least
    send[order[~covered[order]]] = True
    return covered, send


def _window_pass(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        path = next(p for p, k in zip(t.column("path").to_pylist(), t.column("kind").to_pylist()) if k == CHUNKED)
        chunk = t.column("chunk")[0].as_py()
        c = Chunk(path)
        lists = [unpack_sets(b) for b, k in zip(t.column("payload").to_pylist(), t.column("kind").to_pylist()) if k == STATE]
        cover = _merged([c.cover, *(x[0] for x in lists)])
        need = np.setdiff1d(_merged([c.need, *(x[1] for x in lists)]), cover)
        doc, start, hashes = _window_table(c, need)
        ids, _ = _ids(c.table)
        _, send = _local_windows(hashes, ids[doc])
        s = np.flatnonzero(send)
        out = [_row([(CHUNKED, chunk, chunk % buckets, path, pack_sets(cover, need))])]
        out += _dealt(chunk, path, _window_key(hashes[s]), hashes[s] & np.uint64(0xFFFFFFFFFF), ids[doc[s]], np.zeros(len(s), bool), s, buckets)
        return pa.Table.from_batches(out)

    return run


def _window_key(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits; the lower 40 travel as context, so all 64 are compared."""
    return h >> np.uint64(24)


def _window_bucket(t: pa.Table) -> pa.Table:
    """One bucket of windows: those that stand in a smaller document too."""
    out, parts = [], []
    for kind, chunk, bucket, path, b in zip(*(t.column(i).to_pylist() for i in range(5))):
        if kind == SENT:
            key, ctx, doc, _, index = unpack(b, True)
            parts.append((key, ctx, doc, np.full(len(key), chunk), index))
        else:
            out.append((kind, chunk, bucket, path, b))
    if parts:
        key, ctx, doc, chunk, index = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, ctx, key))
        key, ctx, doc, chunk, index = (x[order] for x in (key, ctx, doc, chunk, index))
        new = _heads(key, ctx)
        covered = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        for c, b in _by_chunk(chunk[covered], index[covered], np.ones(int(covered.sum()), bool), np.zeros(int(covered.sum()), bool)):
            out.append((STATE, c, 0, None, b))
    return pa.Table.from_batches([_row(out)])


def _removed(t: pa.Table) -> tuple[Chunk, np.ndarray]:
    """(chunk, which of its bytes go)."""
    kinds, payloads = t.column("kind").to_pylist(), t.column("payload").to_pylist()
    i = kinds.index(CHUNKED)
    c = Chunk(t.column("path")[i].as_py())
    cover, need = unpack_sets(payloads[i])
    doc, start, hashes = _window_table(c, need)
    ids, _ = _ids(c.table)
    found = [unpack_sets(b)[0] for b, k in zip(payloads, kinds) if k == STATE]
    covered, _ = _local_windows(hashes, ids[doc])
    # a window is covered by a smaller document of its chunk, or by one that its bucket found
    covered[_merged(found)] = True
    gone = np.zeros(len(c.buf) + 1, np.int32)
    np.add.at(gone, c.first[cover], 1)
    np.add.at(gone, c.last[cover] + LENGTH, -1)
    np.add.at(gone, start[covered], 1)
    np.add.at(gone, start[covered] + LENGTH, -1)
    return c, np.cumsum(gone[:-1]) > 0


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(t: pa.Table) -> pa.Table:
    give_back()
    c, gone = _removed(t)
    n_removed, n_spans, sha = [], [], []
    for i in range(len(c.off) - 1):
        a, b = c.off[i], c.off[i + 1]
        g = gone[a:b]
        n = int(g.sum())
        n_removed.append(n)
        n_spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0)
        sha.append(hashlib.sha256(c.buf[a:b][~g].tobytes() if n else c.buf[a:b].tobytes()).hexdigest())
    return pa.Table.from_arrays([c.table.column("doc_id").cast(pa.int64()), pa.array(np.diff(c.off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(names: list[str]):
    def run(t: pa.Table) -> pa.Table:
        give_back()
        c, gone = _removed(t)
        lead = (c.buf & 0xC0) != 0x80  # a character goes when all its bytes go
        whole = np.flatnonzero(lead)
        if len(whole):
            all_gone = np.logical_and.reduceat(gone, whole)
            gone = np.repeat(all_gone, np.diff(np.concatenate([whole, [len(c.buf)]])))
        texts = []
        valid = c.table.column("text").combine_chunks().is_valid().to_pylist()
        for i in range(len(c.off) - 1):
            a, b = c.off[i], c.off[i + 1]
            texts.append(c.buf[a:b][~gone[a:b]].tobytes().decode() if valid[i] else None)
        cols = {n: c.table.column(n) for n in names}
        cols["text"] = pa.array(texts, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
        return pa.table(cols)

    return run


def _passes(docs: DataFrame, buckets: int | None) -> DataFrame:
    spark = docs.sparkSession
    buckets = buckets or partitions(spark)
    folder = scratch_path(spark, "suffix-chunks")
    sent = docs.transform(mapped(_first_pass(buckets, folder), ROWS))
    runs = written(sent.groupBy("bucket").applyInArrow(_suffix_bucket, ROWS), "suffix-runs")
    asked = runs.groupBy("chunk").applyInArrow(_window_pass(buckets), ROWS)
    return written(asked.groupBy("bucket").applyInArrow(_window_bucket, ROWS), "suffix-windows")


def digests(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller doc_id.  Null texts are empty; texts under 50 bytes lose
    nothing; rows that share a doc_id are not smaller than one another; rows
    with a null id lose nothing and take nothing from others; an empty table
    gives no rows; other columns are ignored.
    """
    return _passes(docs.select("doc_id", "text"), buckets).groupBy("chunk").applyInArrow(_digests, DIGEST)


def deduplicated(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """All rows in their own columns, repeated passages cut from ``text`` (whole characters only; ``n_chars`` follows)."""
    return _passes(docs, buckets).groupBy("chunk").applyInArrow(_cut(docs.columns), docs.schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What passages repeated from smaller documents leave of all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
