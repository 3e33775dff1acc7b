"""Sorted-string-table shards of token ids.

A shard is one file::

    magic                       8 bytes
    data blocks                 zstd, a CRC-32 each; entries are
                                varint shared, varint unshared, varint value length,
                                unshared key bytes, value; then the restart offsets
                                (u32 each) and their number (u32)
    index block                 for each data block: last key, offset, size
    Bloom filter                of the keys
    footer                      offsets and sizes of both, entries, CRC-32, magic

Keys are order-preserving bytes of the 64-bit identifier and keys share prefixes
within a restart run.  A lookup asks the Bloom filter, bisects the sparse block
index, bisects the block's restarts, and scans one run.  Values are token ids,
two bytes each where all of them fit.

Shards lie in the shared folder.  A task writes under a name of its own attempt
and then reports it; only reported files are read, so lost or repeated tasks do
no harm.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import chunks, mapped, partitions, scratch_path, written
from .wordscan import mix

MAGIC = b"SILTSST1"
RESTART = 16
BLOCK = 64 << 10
SHARD = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQI8s")


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    """Order-preserving key: null first, then by number; repeats of an identifier follow each other."""
    return (b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + (struct.pack(">I", repeat) if repeat else b"")


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def value_of(ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = s = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << s
        if c < 128:
            return n, at
        s += 7


def _probes(key: bytes, bits: int) -> np.ndarray:
    h = np.array([zlib.crc32(key) | zlib.crc32(key[::-1], 0x5BD1E995) << 32], np.uint64)
    h1, h2 = mix(h), mix(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (h1 + np.arange(BLOOM_HASHES, dtype=np.uint64) * h2) % np.uint64(bits)


class Writer:
    """Writes one shard to a binary stream; keys must ascend."""

    def __init__(self, out):
        self._out, self._at = out, 0
        self._block, self._restarts, self._count, self._last = bytearray(), [], 0, b""
        self._index, self._keys, self.entries = [], [], 0
        self._zip = zstandard.ZstdCompressor(level=1)
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self._out.write(b)
        self._at += len(b)

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key <= self._last:
            raise ValueError("keys must ascend")
        shared = 0
        if self._count % RESTART:
            most = min(len(key), len(self._last))
            while shared < most and key[shared] == self._last[shared]:
                shared += 1
        else:
            self._restarts.append(len(self._block))
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._last = key
        self._keys.append(key)
        self._count += 1
        self.entries += 1
        if len(self._block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self._count:
            raw = bytes(self._block) + struct.pack(f"<{len(self._restarts)}II", *self._restarts, len(self._restarts))
            z = self._zip.compress(raw)
            self._index.append((self._last, self._at, len(z) + 4))
            self._put(z + struct.pack("<I", zlib.crc32(z)))
            self._block, self._restarts, self._count = bytearray(), [], 0

    @property
    def size(self) -> int:
        return self._at + len(self._block)

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self._index)
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = np.zeros(bits, bool)
        for k in self._keys:
            bloom[_probes(k, bits)] = True
        packed = np.packbits(bloom).tobytes()
        at = self._at
        self._put(index + packed)
        self._put(FOOTER.pack(at, len(index), at + len(index), bits, self.entries, zlib.crc32(index + packed), MAGIC))


class Reader:
    """Reads a shard from a random-access stream."""

    def __init__(self, f):
        self._f = f
        self._zip = zstandard.ZstdDecompressor()
        end = f.size() if callable(getattr(f, "size", None)) else f.seek(0, 2)
        f.seek(end - FOOTER.size)
        at, n, bloom_at, bits, self.entries, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(at)
        raw = f.read(n + (bits + 7) // 8)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("not a shard, or a damaged one")
        self._bits, self._bloom, self._index, p = bits, np.frombuffer(raw, np.uint8, offset=n), [], 0
        while p < n:
            k, p = _read_varint(raw, p)
            self._index.append((raw[p : p + k], *struct.unpack_from("<QQ", raw, p + k)))
            p += k + 16

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n = self._index[i]
        self._f.seek(at)
        z = self._f.read(n)
        if zlib.crc32(z[:-4]) != struct.unpack("<I", z[-4:])[0]:
            raise ValueError("a damaged block")
        raw = self._zip.decompress(z[:-4])
        (r,) = struct.unpack_from("<I", raw, len(raw) - 4)
        return raw[: len(raw) - 4 - 4 * r], list(struct.unpack_from(f"<{r}I", raw, len(raw) - 4 - 4 * r))

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            s, at = _read_varint(raw, at)
            u, at = _read_varint(raw, at)
            v, at = _read_varint(raw, at)
            key = key[:s] + raw[at : at + u]
            yield key, raw[at + u : at + u + v]
            at += u + v

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self._index)):
            raw, _ = self._block(i)
            yield from self._entries(raw, 0, len(raw))

    def may_hold(self, key: bytes) -> bool:
        p = _probes(key, self._bits).astype(np.int64)
        return bool((self._bloom[p >> 3] >> (7 - (p & 7)) & 1).all())

    def get(self, key: bytes) -> bytes | None:
        """The value of ``key`` or None: Bloom filter, block index, restarts, one run."""
        if not self.may_hold(key):
            return None
        i = bisect.bisect_left(self._index, key, key=lambda x: x[0])
        if i == len(self._index):
            return None
        raw, restarts = self._block(i)
        first = lambda r: next(self._entries(raw, r, len(raw)))[0]
        j = max(0, bisect.bisect_right(restarts, key, key=first) - 1)
        for k, v in self._entries(raw, restarts[j], restarts[j + 1] if j + 1 < len(restarts) else len(raw)):
            if k == key:
                return v
        return None


def opened(path: str, mode: str):
    """A stream on any file system that arrow knows by its scheme."""
    where, p = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    if mode == "w":
        if isinstance(where, fs.LocalFileSystem):
            where.create_dir(p.rsplit("/", 1)[0])
        return where.open_output_stream(p)
    return where.open_input_file(p)


MANIFEST = "part long, seq long, path string, docs long, tokens long, bytes long, first_id long, last_id long"


def _shards(folder: str, vocabulary: str, end_id: int, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.MemoTokenizer(vocabulary)
        part, seq, rows = TaskContext.get().partitionId(), 0, []
        out = w = None
        last, repeat = object(), 0

        def close() -> None:
            nonlocal seq, w
            w.close()
            out.close()
            rows.append((part, seq, path, w.entries, tokens, w.size, first, last))
            seq, w = seq + 1, None

        for batch, _, _ in chunks(batches, "text", bpe.TEXT_BYTES):
            ids, off = tok.encode([t or "" for t in batch.column(1).to_pylist()])
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if w and doc != last and w.size >= most:
                    close()
                repeat = repeat + 1 if doc == last else 0
                last = doc
                if not w:
                    path, tokens, first = f"{folder}/shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:12]}.sst", 0, doc
                    out = opened(path, "w")
                    w = Writer(out)
                x = np.append(ids[off[i] : off[i + 1]], np.uint32(end_id))
                w.add(key_of(doc, repeat), value_of(x))
                tokens += len(x)
        if w:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5])], ["part", "seq", "path", "docs", "tokens", "bytes", "first_id", "last_id"])

    return write


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 2, shard_bytes: int = SHARD) -> DataFrame:
    """Encode documents and write shards in ascending doc_id order; returns the manifest.

    Ranges of doc_id are cut by sampled quantiles of the id, never by source, so
    a hot source spreads.  Null texts are empty; null ids come first; repeated
    ids keep their rows, in the order of their texts; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sst")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(d.transform(mapped(_shards(folder, vocabulary or bpe.default_path(), end_id, shard_bytes), MANIFEST)), "sst-manifest")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            with opened(path, "r") as f:
                for key, value in Reader(f):
                    x = ids_of(value)
                    rows.append((id_of(key), base, len(x), zlib.crc32(x.tobytes())))
                    base += len(x)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read every shard back: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32.

    The running total is over the manifest, a row per 64 MB shard.
    """
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.select("path", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    return m.repartition(partitions(manifest.sparkSession), "path").transform(mapped(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """Ids of one document: its shard by the manifest's ranges, then the shard's own index."""
    for r in manifest.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).select("path").collect():
        with opened(r.path, "r") as f:
            if (v := Reader(f).get(key_of(doc_id))) is not None:
                return ids_of(v)
    return None


def op5_token_sst(spark, sf_dir: str) -> DataFrame:
    """Every document through sorted-string-table shards and back."""
    return read_digests(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
