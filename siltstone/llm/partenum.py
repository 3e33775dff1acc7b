"""N-gram Jaccard join by PartEnum signatures.

The feature domain (hashes of five-word shingles) is cut into first-level
partitions, each of them into second-level ones, and every subset of two
second-level partitions of a first-level one is enumerated as a signature: the
content of both, for the size band.  Two sets of Jaccard similarity 3/4 or more
differ in at most k = (|u| + |v|) / 7 features, so of a set's ``full`` (not empty)
second-level partitions at least full - k agree with the other set's.  With more
of those than first-level partitions, two of them share one, and the pair has a
signature in common.

* A set emits signatures in the scheme of its own size band and in those of the
  lower bands that a similar smaller set can have.
* A set with too few full partitions (a pair without a common signature has two
  such sets) emits single partitions as well, and empty ones if need be.
* The surplus = full - k - first-level partitions - 1 allows more.  In the scheme
  of a lower band a set only looks for smaller sets, and leaves out so many full
  partitions that ``spare`` agreements are left over; in that of its own band it
  leaves out none.  Any pair that is similar has 1 + ``slack`` signatures in common,
  slack being the less of either set's surplus and of spare: a set with at most so
  many signatures in crowded groups finds all its partners elsewhere.
* Signatures are made and met in rounds, each over a range of them, so that only a
  part of them is on disk at a time.

Signatures travel packed (40-bit values in order, delta-coded) and meet bucket
by bucket.  Groups don't become pairs: members are first paired with their
group's least member only, verified and united; then only groups that still hold
several components give pairs across components (small groups).  Sets without
slack that crowded groups hold get an exact way of their own: each feature is a
partition by itself there, and a set enters the groups of those of its rarest
features, of which similar sets must share one.  A safe bound from bit sketches
drops most false pairs before texts are fetched; similarity is then verified on
whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, flat, give_back, mapped, partitions
from .common import written as _written
from .wordscan import SPACED, Words, mix, shingles

K = 5
written = partial(_written, swept=True)
#: Members of a group that is paired across components at once; more make it crowded.
CROWD = 24
#: Sets of one chunk that share a signature before the chunk sends one of them to the bucket.
LOCAL = 64
CHUNK_SHINGLES = 1 << 19
#: Text bytes whose signatures meet in one bucket; beyond so many buckets (400 GB) they grow instead.
BUCKET_BYTES, MOST_BUCKETS = 6 << 20, 1 << 16
#: Bits of a signature; with many buckets those within a bucket stay as many, so that chance equals grow as the input does.
SIG_BITS, BITS_IN_BUCKET = 40, 34
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sig_bits(buckets: int) -> int:
    return max(SIG_BITS, BITS_IN_BUCKET + (buckets - 1).bit_length())


def rounds(buckets: int) -> int:
    """Parts in which the signatures are made: from 48 MB of text two, from 12 GB three, since owners' keys are listed once a bucket."""
    return 1 + (buckets >= 8) + (buckets >= 2048)


@lru_cache(1)
def bands(most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; a band's sizes differ by a third at most."""
    hi = [0, 1]
    while hi[-1] < most:
        hi.append(max(hi[-1] + 1, hi[-1] * 4 // 3))
    return np.array(hi)


@lru_cache(None)
def scheme(band: int) -> tuple[int, int, int, int]:
    """(k, n, n1, n2) of a band: features that may differ, second-level partitions, first-level ones, and second-level ones in each.

    The smallest sets of the band have so many full partitions that n1 is exceeded by 2.5 standard deviations.
    """
    lo, hi = int(bands()[band - 1]) + 1, int(bands()[band])
    k = (hi + hi * 4 // 3) // 7
    n = max(48, lo * 3 // 2)
    none, two = np.exp(lo * np.log1p(-1 / n)), np.exp(lo * np.log1p(-2 / n))
    spare = n * (1 - none) - k - 2.5 * np.sqrt(max(0.0, n * (n - 1) * two + n * none - (n * none) ** 2))
    n2 = -(-n // max(1, int(spare)))
    return k, n, -(-n // n2), n2


def band_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(bands(), size, "left")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start[i] .. start[i] + size[i], one range after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def set_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set of hashes, as signed numbers."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    return mix((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(np.uint64)).view(np.int64)


def spare(n1: np.ndarray) -> np.ndarray:
    """Agreements beyond the needed ones that sets of a higher band keep in a scheme of ``n1`` first-level partitions."""
    return n1 // 8


def kept(first: np.ndarray, row: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Marks the full partitions that stay when each set leaves out ``drop`` of them, those of its fullest first-level ones."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    head = np.flatnonzero(new)
    place = np.arange(len(first)) - np.repeat(head, np.diff(np.append(head, len(first))))  # so many pairs fall away with it
    order = np.lexsort((-place, row))
    full = np.bincount(row, minlength=len(drop))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    return rank >= drop[row]


def signatures(h: np.ndarray, off: np.ndarray, bits: int = SIG_BITS, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures from ``low`` to below ``high``, set number of each, slack of each set) of sorted distinct hashes."""
    size = np.diff(off)
    some = np.flatnonzero(size)
    slack = np.full(len(size), 1 << 30)
    sigs, owner = [], []
    own = band_of(size)
    lowest = band_of(-(-size * 3 // 4))
    mixed = mix(h)

    def give(x: np.ndarray, sets: np.ndarray) -> None:
        x = mix(x) >> np.uint64(64 - bits)
        if low or high is not None:
            here = (x >= np.uint64(low)) & (x < np.uint64(1 << bits if high is None else high))
            x, sets = x[here], sets[here]
        sigs.append(x)
        owner.append(sets)

    for step in range(4):
        sets = some[own[some] - step >= lowest[some]]
        if not len(sets):
            break
        band = own[sets] - step
        kinds, at_kind = np.unique(band, return_inverse=True)
        k, n, n1, n2 = np.array([scheme(b) for b in kinds.tolist()], np.int64).T[:, at_kind]
        idx = ranges(off[sets], size[sets])
        part = ((h[idx] >> np.uint64(32)) * np.repeat(n, size[sets]).astype(np.uint64)) >> np.uint64(32)
        row = np.repeat(np.arange(len(sets)), size[sets])
        new = np.ones(len(idx), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        part, row = part[at].astype(np.int64), row[at]
        content = mix(np.add.reduceat(mixed[idx], at) ^ mix(part.astype(np.uint64) << np.uint64(16) | band[row].astype(np.uint64)))
        first = row * (int(n1.max()) + 1) + part // n2[row]
        full = np.bincount(row, minlength=len(sets))
        left = full - k - n1
        slack[sets] = np.minimum(slack[sets], np.minimum(left - 1, spare(n1)))
        c, f, r = content, first, row
        if step:
            stay = kept(first, row, np.maximum(0, left - 1 - spare(n1)))
            c, f, r = content[stay], first[stay], row[stay]
        for d in range(1, len(f)):
            i = np.flatnonzero(f[d:] == f[:-d])
            if not len(i):
                break
            give(c[i] * _ODD + c[i + d], sets[r[i]])
        few = left <= 0
        one = few[row]
        give(content[one], sets[row[one]])
        for i in np.flatnonzero(few & (full <= k)).tolist():  # too many empty partitions: these count as signatures
            empty = np.setdiff1d(np.arange(n[i]), part[row == i]).astype(np.uint64)
            give(mix(empty << np.uint64(16) | np.uint64(band[i])) + np.uint64(1), np.full(len(empty), sets[i]))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), slack
    return np.concatenate(sigs), np.concatenate(owner), slack


def cells_of(n: int) -> int:
    """Cells of a sketch of ``n`` hashes, as a power of two."""
    return max(4, (2 * n).bit_length())


def sketch(h: np.ndarray) -> bytes:
    """Which of 2**c equal cells of the hash range a set touches, two to four cells for each member."""
    c = cells_of(len(h))
    bits = np.zeros(1 << c, bool)
    bits[(h >> np.uint64(64 - c)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches (bytes) brought down to ``size`` bytes: neighbouring cells become one."""
    while x.shape[-1] > size:
        bits = np.unpackbits(x, axis=-1)
        x = np.packbits(bits[..., ::2] | bits[..., 1::2], axis=-1)
    return x


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if the two sets differ in more features than similar ones can: a cell that one touches holds a difference."""
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = folded(x, len(y)), folded(y, len(x))
    return 7 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= na + nb


def pack(sig: np.ndarray, idx: np.ndarray, keys: np.ndarray) -> bytes:
    """Ascending signatures, delta-coded, with twice their owner's number (odd: of a crowded group); owners' keys are listed once.

    Bytes stand in columns; only the highest columns, which are mostly zero, are compressed.
    """
    head, body = [len(sig).to_bytes(4, "little")], []
    for x in (np.diff(sig, prepend=np.uint64(0)), idx.astype(np.uint64)):
        wide = max(1, (int(x.max()).bit_length() + 7) // 8)
        cols = x.astype("<u8").view(np.uint8).reshape(-1, 8)
        top = zlib.compress(cols[:, wide - 1].tobytes(), 1)
        head.append(wide.to_bytes(1, "little") + len(top).to_bytes(4, "little"))
        body += [cols[:, i].tobytes() for i in range(wide - 1)] + [top]
    return b"".join(head + body) + keys.astype("<i8").tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, keys, hot)."""
    n, at, out = int.from_bytes(b[:4], "little"), 14, []
    for w in (4, 9):
        wide, top = b[w], int.from_bytes(b[w + 1 : w + 5], "little")
        x = np.zeros((n, 8), np.uint8)
        for i in range(wide - 1):
            x[:, i] = np.frombuffer(b, np.uint8, n, at)
            at += n
        x[:, wide - 1] = np.frombuffer(zlib.decompress(b[at : at + top]), np.uint8)
        at += top
        out.append(x.view("<u8").ravel())
    keys = np.frombuffer(b, np.uint8, len(b) - at, at).view("<i8") if len(b) > at else np.zeros(0, np.int64)
    return np.cumsum(out[0], dtype=np.uint64), keys[(out[1] >> np.uint64(1)).astype(np.int64)], (out[1] & np.uint64(1)).astype(bool)


def grouped(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (signature, owner's number) in order."""
    low = max(1, int(owner.max()).bit_length()) if len(owner) else 1
    if len(sig) and int(sig.max()).bit_length() + low > 64:  # more owners than a packed number holds
        order = np.lexsort((owner, sig))
        s, o = sig[order], owner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
        return s[new], o[new]
    v = np.sort(sig << np.uint64(low) | owner.astype(np.uint64))
    v = v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v
    return v >> np.uint64(low), (v & np.uint64((1 << low) - 1)).astype(np.int64)


def unique_pairs(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different numbers below ``most``."""
    x, y = np.divmod(np.unique(a * most + b), most) if len(a) else (a, b)
    return x[x != y], y[x != y]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(keys, return_counts=True)
    return u, n.astype(np.int64)


OUT = "kind int, doc_id long, n long, key long, h long, slack int, sketch binary, bucket int, payload binary"
_KINDS = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.int32(), pa.binary()]
DOC, SET, SIGS, STAR, GROUP, CROWDED = range(6)


def _rows(schema: str, kinds: list, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names)


def _emit(buckets: int, start: int = 0, end: int | None = None):
    """Documents, sets and the signatures of the buckets from ``start`` to below ``end``; only with the first bucket come documents and sets."""
    bits, end = sig_bits(buckets), buckets if end is None else end
    edges = [-(-(i << bits) // buckets) for i in range(start, end + 1)]  # a bucket is a range of signatures

    def dealt(keys: np.ndarray) -> np.ndarray:
        return start + keys % (end - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, sizes, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            keys = set_keys(h, off)
            _, first = np.unique(keys, return_index=True)  # equal sets of a chunk are one
            first = np.sort(first[np.diff(off)[first] > 0])
            idx = ranges(off[first], np.diff(off)[first])
            sub, sub_off, sub_keys = h[idx], np.concatenate([[0], np.cumsum(np.diff(off)[first])]), keys[first]
            sig, owner, slack = signatures(sub, sub_off, bits, edges[0], edges[-1])
            for a in range(0, 0 if start else len(first), 4096):
                r = range(a, min(a + 4096, len(first)))
                yield _rows(OUT, _KINDS, kind=np.full(len(r), SET), key=sub_keys[r.start : r.stop], n=np.diff(sub_off)[r.start : r.stop], slack=np.clip(slack[r.start : r.stop], -1, 1 << 20), sketch=[sketch(sub[sub_off[i] : sub_off[i + 1]]) for i in r], bucket=dealt(sub_keys[r.start : r.stop]))
            del sub
            # signatures that many sets of this chunk share: pairs with the least key go on directly, it stands for all in the bucket
            order = np.argsort(sub_keys)  # owners in the order of their keys: the least of a group comes first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sub_keys = sub_keys[order]
            s, o = grouped(sig, rank[owner])
            del sig, owner, order
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([head, [len(s)]]))
            many = np.repeat(count > LOCAL, count)
            if many.any():
                sat, times = counted(o[many])
                yield _rows(OUT, _KINDS, kind=np.full(len(sat), CROWDED), n=times, key=sub_keys[sat], bucket=dealt(sub_keys[sat]))
                x, y = unique_pairs(np.repeat(o[head], count)[many], o[many], len(sub_keys))
                for a in range(0, len(x), 50_000):
                    p, q = sub_keys[x[a : a + 50_000]], sub_keys[y[a : a + 50_000]]
                    yield _rows(OUT, _KINDS, kind=np.full(len(p), STAR), n=p, key=q, bucket=dealt(q))
                keep = ~many
                keep[head] = True
                s, o, many = s[keep], o[keep], many[keep]
            cut = np.searchsorted(s, np.array(edges, np.uint64))
            got = [i for i in range(end - start) if cut[i + 1] > cut[i]]
            for a in range(0, len(got), 64):
                part, body = got[a : a + 64], []
                for i in part:
                    x = slice(cut[i], cut[i + 1])
                    used, idx = np.unique(o[x], return_inverse=True)
                    body.append(pack(s[x] - np.uint64(edges[i]), idx << 1 | many[x], sub_keys[used]))
                yield _rows(OUT, _KINDS, kind=np.full(len(part), SIGS), bucket=start + np.array(part), payload=body)
            hs.clear()
            sizes.clear()

        for part, buf, off in chunks(batches, "text"):
            h, o = shingles(Words(buf, off, SPACED), K)
            if not start:
                yield _rows(OUT, _KINDS, kind=np.full(part.num_rows, DOC), doc_id=part.column(0).cast(pa.int64()), h=part.column(2), n=np.diff(o), key=(keys := set_keys(h, o)), bucket=dealt(keys))
            hs.append(h)
            sizes.append(np.diff(o))
            size += len(h)
            if size > CHUNK_SHINGLES:
                yield from out()
                size = 0
        if sizes:
            yield from out()

    return run


MET = "kind int, doc_id long, n long, key long, h long, slack int, sketch binary, members array<long>"
_MET = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.list_(pa.int64())]


def _meet(t: pa.Table) -> pa.Table:
    """One bucket: documents and sets pass through; signatures give star pairs, small groups and crowded ones."""
    t = t.combine_chunks()
    kind = t.column("kind").to_numpy()
    rest = t.filter(pa.array(kind != SIGS))
    out = [_rows(MET, _MET, **{c: rest.column(c).combine_chunks() for c in ("kind", "doc_id", "n", "key", "h", "slack", "sketch")})]
    packed = t.filter(pa.array(kind == SIGS)).column("payload")
    if len(packed):
        parts = [unpack(b.as_py()) for b in packed]
        sig, key, hot = (np.concatenate(x) for x in zip(*parts))
        del parts
        known, idx = np.unique(key, return_inverse=True)
        led = np.unique(sig[hot])  # of crowded groups
        s, idx = grouped(sig, idx)
        del sig, key
        same = s[1:] == s[:-1]  # only signatures that come twice go on, and crowded ones
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        s, idx = s[twice], idx[twice]
        key = known[idx]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([head, [len(s)]]))
        each = np.repeat(count, count)
        x, y = unique_pairs(np.repeat(idx[head], count), idx, len(known))
        out.append(_rows(MET, _MET, kind=np.full(len(x), STAR), n=known[x], key=known[y]))
        crowded = np.isin(s, led) | (each > CROWD)
        held, times = counted(key[crowded])
        out.append(_rows(MET, _MET, kind=np.full(len(held), CROWDED), n=times, key=held))
        small = np.flatnonzero((count > 2) & ~crowded[head]) if len(s) else head
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key.view(np.uint64)), dtype=np.uint64)])
        _, pick = np.unique(total[head[small] + count[small]] - total[head[small]], return_index=True)
        small = small[pick]
        if len(small):
            idx = ranges(head[small], count[small])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[small])]), pa.int32()), pa.array(key[idx]))
            out.append(_rows(MET, _MET, kind=np.full(len(small), GROUP), members=lists))
    return pa.Table.from_batches(out)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, na, nc, sa, sc = (b.column(i) for i in range(6))
        ok = [may_link(x, y, m, n) for x, y, m, n in zip(sa.to_pylist(), sc.to_pylist(), na.to_pylist(), nc.to_pylist())]
        yield pa.RecordBatch.from_arrays([a, c], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose whole texts' shingle sets are similar enough."""
    memo: dict = {}
    for b in batches:
        keep = []
        for key, t, u in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
            if key not in memo:
                memo.clear()
                memo[key] = shingles(Words(*flat(pa.array([t.as_py()])), SPACED), K)[0]
            x = memo[key]
            y, _ = shingles(Words(*flat(pa.array([u.as_py()])), SPACED), K)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: Bits of the filter that keeps texts nobody asks for out of a shuffle (8 MB), and of one block of it.
FILTER_BITS, FILTER_BLOCK = 26, 20


def _bits(t: pa.Table) -> pa.Table:
    at = t.column("at").to_numpy() & ((1 << FILTER_BLOCK) - 1)
    bits = np.zeros(1 << FILTER_BLOCK, bool)
    bits[at] = True
    return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(key, text) for ``need(key, doc_id)``.  Only rows that pass a Bloom filter of the wanted ids, of fixed size, are shuffled."""
    spark = docs.sparkSession
    need = written(need, "partenum-need")
    places = lambda c: [F.shiftrightunsigned(F.xxhash64(c, F.lit(i)), 64 - FILTER_BITS) for i in range(3)]
    at = need.select(F.explode(F.array(*places(F.col("doc_id").cast("long")))).alias("at")).distinct()
    blocks = at.withColumn("block", F.shiftright("at", FILTER_BLOCK).cast("int")).groupBy("block").applyInArrow(_bits, "block int, bits binary").collect()
    table = bytearray(1 << (FILTER_BITS - 3))
    for r in blocks:
        table[r.block << (FILTER_BLOCK - 3) : (r.block + 1) << (FILTER_BLOCK - 3)] = r.bits
    known = spark.sparkContext.broadcast(bytes(table))

    def wanted(*places: pa.Array) -> pa.Array:
        bits = np.frombuffer(known.value, np.uint8)
        ok = np.ones(len(places[0]), bool)
        for p in places:
            p = p.to_numpy()
            ok &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(ok)

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = some.where(F.arrow_udf(wanted, "boolean")(*places(F.col("doc_id"))))
    out = written(some.join(need, "doc_id").transform(mapped(_own_text, "key long, text string")).groupBy("key").agg(F.first("text").alias("text")), "partenum-texts")
    known.destroy()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, source) -> DataFrame:
    """Links among candidate pairs (a, b), by whole texts: ``source`` gives (key, text) for (key, doc_id)."""
    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    p = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
    p = written(p.transform(mapped(_plausible, "a long, b long")), "partenum-pairs")
    need = p.select("a").union(p.select("b")).distinct().join(sets, F.col("a") == F.col("key")).select("key", F.col("rep").alias("doc_id"))
    texts = source(need)
    p = p.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return written(p.select("a", "b", "ta", "tb").transform(mapped(_linked, "a long, b long")), "partenum-links")


def _crowd_links(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Links between the sets of two blocks of a crowd (or within one) that are not yet in one component, thinned to a forest."""
    t = t.sort_by("n").combine_chunks()
    ks, n, block = (t.column(c).to_numpy() for c in ("key", "n", "block"))
    comps = t.column("comp").to_numpy()
    label = np.unique(comps, return_inverse=True)[1]
    hs = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("hashes").combine_chunks()]
    two = key[1].as_py() != key[2].as_py()
    cells = np.array([cells_of(int(x)) for x in n])
    upto = np.searchsorted(n, n * 4 // 3, "right")  # partners of a set are larger than it by a third at most
    fa, fb = [], []
    for c in np.unique(cells).tolist():
        lo, hi, end = np.searchsorted(cells, [c, c + 1, c + 2]).tolist()
        bits = np.concatenate([folded(np.frombuffer(sketch(h), np.uint8)[None, :], 1 << (c - 3)) for h in hs[lo:end]])
        for i in range(lo, hi):
            j = np.arange(i + 1, upto[i])
            j = j[(label[j] != label[i]) & (block[j] != block[i])] if two else j[label[j] != label[i]]
            if not len(j):
                continue
            j = j[7 * np.bitwise_count(bits[j - lo] ^ bits[i - lo]).sum(1, dtype=np.int64) <= n[i] + n[j]]
            for q in j.tolist():
                if label[q] == label[i]:
                    continue
                both = len(np.intersect1d(hs[i], hs[q], assume_unique=True))
                if 100 * both >= 75 * (n[i] + n[q] - both):
                    fa.append(ks[i])
                    fb.append(ks[q])
                    label[label == label[q]] = label[i]
    del hs
    return pa.table({"a": pa.array(fa, pa.int64()), "b": pa.array(fb, pa.int64())})


def _linked_block(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    out = _crowd_links(key, t)
    give_back()
    return out


#: Most sets of a block, and most bytes of their texts (their hashes are one and a half times that, four times at most).
BLOCK, BLOCK_TEXT = 4096, 8 << 20
#: Cells in which features are counted: 8 MB, cut into blocks to add up.
SLOT_BITS, SLOT_BLOCKS = 20, 64


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for part, buf, off in chunks(batches, "text"):
        h, _ = shingles(Words(buf, off, SPACED), K)
        total += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
    for i, x in enumerate(np.split(total, SLOT_BLOCKS)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["block", "counts"])


def _summed(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in t.column("counts"))
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _rarest(known):
    """(f, key): of each set so many of its rarest features that similar sets have one of them in common; those that no other set holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, "<i8")
        for part, buf, off in chunks(batches, "text"):
            h, o = shingles(Words(buf, off, SPACED), K)
            size = np.diff(o)
            often = table[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, often, row))
            place = np.arange(len(h)) - np.repeat(o[:-1], size)
            take = order[(place <= np.repeat(size - -(-3 * size // 4), size)) & (often[order] > 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(part.column(0).to_numpy()[row[take]])], ["f", "key"])

    return run


def _rooted(df: DataFrame, comp: DataFrame, key: str, name: str) -> DataFrame:
    c = comp.select(F.col("node").alias(key), F.col("root").alias(name))
    return df.join(c, key, "left").withColumn(name, F.coalesce(name, key))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, comp, "a", "ra"), comp, "b", "rb").where("ra <> rb").select("a", "b")


def _across(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within small groups ``(g, key)``."""
    m = _rooted(groups, comp, "key", "root").groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.array_sort(F.collect_set(F.struct("root", "key"))).alias("m")).where("x <> y")
    across = F.transform("m", lambda p: F.transform(F.filter("m", lambda q: (q["root"] != p["root"]) & (q["key"] > p["key"])), lambda q: F.struct(p["key"].alias("a"), q["key"].alias("b"))))
    return m.select(F.explode(F.flatten(across)).alias("p")).select("p.a", "p.b").distinct()


def _held_apart(held: DataFrame, links: DataFrame, comp: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The links, with those among sets that crowded groups hold, found by their rarest features.

    How often a feature occurs is counted in ``2**SLOT_BITS`` cells of fixed
    size: equal cells only change which features count as rare, never a result.
    """
    spark = docs.sparkSession
    texts = _texts(docs, held.join(sets, "key").select("key", F.col("rep").alias("doc_id")))
    source = lambda need: texts.join(need.select("key"), "key")
    counts = texts.transform(mapped(_frequencies, "block int, counts binary")).groupBy("block").applyInArrow(_summed, "block int, counts binary")
    known = spark.sparkContext.broadcast(b"".join(r.counts for r in sorted(counts.collect(), key=lambda r: r.block)))
    rare = written(texts.transform(mapped(_rarest(known), "f long, key long")), "partenum-rare")
    known.destroy()
    mixed = lambda e: e.groupBy("f").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("key").alias("a"), F.count("*").alias("c")).where("x <> y")
    rooted = _rooted(rare, comp, "key", "root")
    rows = written(rooted.join(mixed(rooted).select("f", "a", "c"), "f").select("f", "key", "a", "c"), "partenum-mixed")
    if rows.isEmpty():
        return links
    star = rows.select("a", F.col("key").alias("b")).where("a <> b").distinct()
    links = links.union(_verified(_apart(star, comp), sets, source))
    comp = written(components(links), "partenum-comp")
    small = rows.where(F.col("c") <= CROWD).select(F.col("f").alias("g"), "key")
    links = links.union(_verified(_across(small, comp), sets, source))
    comp = written(components(links), "partenum-comp")
    large = _rooted(rows.where(F.col("c") > CROWD).select("f", "key"), comp, "key", "root")
    left = large.join(mixed(large).select("f"), "f", "left_semi").select("f", "key")
    left = written(left.withColumnRenamed("f", "crowd"), "partenum-crowd")
    if not left.isEmpty():
        links = links.union(_crowds(left, comp, texts))
    return links


def _merged(crowds: DataFrame, seed: int) -> DataFrame:
    """Crowds ``(crowd, key)``, those with the same least member (by a hash) made one where that takes no more comparisons.

    The features of a group of near copies are a crowd each, of nearly the same
    sets; sets of a merged crowd are sent and compared once.  All pairs of the
    crowds given stay together in one of those returned.
    """
    own = crowds.groupBy("crowd").agg(F.min(F.xxhash64("key", F.lit(seed))).alias("lead"), F.count("*").alias("c"))
    every = crowds.join(own, "crowd").select("crowd", "key", "lead", "c")
    apart = own.groupBy("lead").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
    once = every.select("lead", "key").distinct().groupBy("lead").agg(F.count("*").cast("double").alias("u"))
    good = apart.join(once, "lead").where("u * u <= pairs").select("lead", F.lit(True).alias("good"))
    named = every.join(good, "lead", "left").select(F.when(F.col("good"), F.col("lead")).otherwise(F.col("crowd")).alias("crowd"), "key")
    return written(named.distinct(), "partenum-crowd")


def _crowds(keys: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within crowds ``(crowd, key)`` that hold several components still, compared block against block.

    Comparing takes a few nanoseconds a pair (a popcount over sketches) and no
    pair becomes a row.  A set's hashes are sent once for each block of its crowd,
    and most crowds have one.  Only sets all of whose rare features are crowded come here.
    """
    spark = keys.sparkSession
    for seed in range(2):
        keys = _merged(keys, seed)
    size = keys.join(texts.select("key", F.octet_length("text").alias("bytes")), "key").groupBy("crowd").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_TEXT)).alias("blocks"))
    dealt = _rooted(keys, comp, "key", "comp").join(size, "crowd").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    dealt = dealt.select("crowd", "key", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("crowd", "key", "comp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    sent = dealt.join(texts.transform(mapped(_hashed, "key long, n long, hashes binary")), "key").repartition(partitions(spark), "crowd", "x", "y")
    return written(sent.groupBy("crowd", "x", "y").applyInArrow(_linked_block, "a long, b long"), "partenum-links")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n: how many, sorted hashes) of (key, text)."""
    for part, buf, off in chunks(batches, "text"):
        h, o = shingles(Words(buf, off, SPACED), K)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(o)), pa.array([h[x:y].astype("<u8").tobytes() for x, y in zip(o[:-1], o[1:])], pa.binary())], ["key", "n", "hashes"])


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the text that has the wanted set (an identifier may come with several texts)."""
    for b in batches:
        for part, buf, off in chunks(iter([b]), "text"):
            h, o = shingles(Words(buf, off, SPACED), K)
            ok = pa.array(set_keys(h, o) == part.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1)], ["key", "text"]).filter(ok)


def _components(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, key, h: hash of the text) of ``docs``, the least doc_id of each set (key, rep), and the components of sets (node, root)."""
    spark = docs.sparkSession
    if not buckets:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(1, -(-size // BUCKET_BYTES)))
    whole = docs.select("doc_id", "text", F.xxhash64("text"))
    cuts = [buckets * i // rounds(buckets) for i in range(rounds(buckets) + 1)]
    parts = [written(whole.transform(mapped(_emit(buckets, a, b), OUT)).groupBy("bucket").applyInArrow(_meet_bucket, MET), "partenum-met") for a, b in zip(cuts[:-1], cuts[1:])]
    met = reduce(DataFrame.union, parts)
    rows = met.where(F.col("kind") == DOC).select("doc_id", "n", "key", "h")
    reps = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    sets = met.where(F.col("kind") == SET).groupBy("key").agg(F.min("n").alias("n"), F.min("slack").alias("slack"), F.min("sketch").alias("sketch"))
    star = written(met.where(F.col("kind") == STAR).select(F.col("n").alias("a"), F.col("key").alias("b")).distinct(), "partenum-star")
    crowd = met.where(F.col("kind") == CROWDED).groupBy("key").agg(F.sum("n").alias("times"))
    lone = star.select(F.col("a").alias("key")).union(star.select("b")).distinct()
    sets = written(sets.join(lone, "key", "left_semi").join(reps, "key"), "partenum-sets")  # a null rep (null ids only) stays

    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    source = lambda need: _texts(docs, need)
    links = _verified(first, sets, source)
    comp = written(components(links), "partenum-comp")
    groups = met.where(F.col("kind") == GROUP).select("members").distinct().select(F.xxhash64("members").alias("g"), F.explode("members").alias("key"))
    more = _apart(star.join(first, ["a", "b"], "left_anti"), comp).union(_across(groups, comp)).distinct()
    links = links.union(_verified(more, sets, source))
    comp = written(components(links), "partenum-comp")
    held = written(crowd.join(sets.select("key", "slack"), "key").where("times > slack").select("key"), "partenum-heavy")
    if not held.isEmpty():
        links = _held_apart(held, links, comp, sets, docs)
        comp = written(components(links), "partenum-comp")
    return rows, reps, comp


def join(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``.

    Rows with equal sets are linked.  Texts without words have no shingles and
    link with nothing: their component is their own id.  Repeated rows are in
    one component.  A null id never names a component unless all its rows have
    null ids, and rows with a null id link with equal sets only.  An empty table
    gives no rows; other columns are ignored.
    """
    rows, reps, comp = _components(docs, buckets)
    class_root = _rooted(reps, comp, "key", "root")
    least = class_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = class_root.join(least, "root").select("key", "component_id")
    return rows.join(names, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _meet_bucket(t: pa.Table) -> pa.Table:
    out = _meet(t)
    give_back()
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of :func:`join`, decided row by row, with all columns.

    It is the row with the smallest ``doc_id`` (of several, that of the smallest
    hash of the text; null ids come last), and one of those that repeat both.
    Rows that share an identifier but no words are apart, and rows without words
    are in no component: all of them stay.  An empty table gives no rows.
    """
    rows, _, comp = _components(docs)
    rooted = _rooted(rows.where("n > 0"), comp, "key", "root")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("m"))
    name = "h"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    best = best.select(F.col("m.doc_id").alias("best_id"), F.col("m.h").alias("best_h"))
    bare = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    worded = docs.where(~bare).withColumn(name, F.xxhash64("text"))
    kept = worded.join(best, worded.doc_id.eqNullSafe(best.best_id) & (worded[name] == best.best_h), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*docs.columns).union(docs.where(bare))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of similar documents among all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
