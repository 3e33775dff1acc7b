"""Exact and near duplicates: mark, never delete.

Every record keeps its row and gets a decision; a cluster's representative is
its smallest member, so results don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import similar
from .graph import components, reliable

PERMUTATIONS, SEED = 128, 1234
#: Hashes of more sets are put last in the order of prefixes, in so many rounds at most; more rows of keys are not broadcast.
CROWD, CROWD_ROUNDS, KEYS = 50, 3, 1 << 19


def index(df: DataFrame, record: str, source: str, kind: str, text: str = "text") -> DataFrame:
    """source_id, record_id, content_type, text (canonical), transforms, canonical_sha256 and text_len."""
    d = df.select(F.col(source).cast("string").alias("source_id"), F.col(record).alias("record_id"), F.col(kind).alias("content_type"), F.col(text).alias("_t"))
    d = T.canonical(d, "_t", "text").drop("_t")
    return d.withColumn("canonical_sha256", F.sha2("text", 256)).withColumn("text_len", F.length("text"))


def exact(idx: DataFrame) -> DataFrame:
    """Adds cluster, size and representative of records with equal canonical text and type; empty texts have none.

    The members' count and least member are aggregated first and joined back, so
    no window ever holds a hot group.
    """
    k = ["content_type", "canonical_sha256"]
    g = idx.where("text_len > 0").groupBy(*k).agg(F.count("*").alias("cluster_size"), F.min(F.struct("source_id", "record_id")).alias("representative")).where("cluster_size > 1")
    out = idx.join(g, k, "left")
    name = F.concat(F.lit("exact:"), "content_type", F.lit(":"), F.substring("canonical_sha256", 1, 16))
    return out.withColumn("cluster_id", F.when(F.col("cluster_size").isNotNull(), name))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def bands_rows(threshold: float, n: int = PERMUTATIONS) -> tuple[int, int]:
    """The (bands, rows) split of ``n`` whose collision curve is nearest one half at the threshold."""
    splits = [(n // r, r) for r in range(1, n + 1) if n % r == 0]
    return min(splits, key=lambda s: abs((1 - (1 - threshold ** s[1]) ** s[0]) - 0.5))


def coefficients(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the permutations."""
    import random

    r, p = random.Random(seed), (1 << 61) - 1
    pairs = [(r.randint(1, p - 1), r.randint(0, p - 1)) for _ in range(n)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def shingle_hashes(shingles: Column) -> Column:
    """First four SHA-1 bytes of each shingle as a little-endian number."""

    def one(s: Column) -> Column:
        h = F.sha1(s)
        return F.conv(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")

    return F.transform(shingles, one)


def minhash(hashes: Column, n: int = PERMUTATIONS, seed: int = SEED) -> Column:
    """Signature of ``n`` minima; the product wraps at 64 bits before the reduction.  Arrow-batched: ANSI arithmetic has no wrapping product."""
    a, b = coefficients(n, seed)
    p, low = np.uint64((1 << 61) - 1), np.uint64(0xFFFFFFFF)

    @F.pandas_udf("array<long>")
    def sign(rows: pd.Series) -> pd.Series:
        def one(h):
            if h is None or len(h) == 0:
                return None
            x = np.full(n, 0xFFFFFFFF, np.uint64)
            v = np.asarray(h, np.uint64)
            for i in range(0, len(v), 4096):
                x = np.minimum(x, (((v[i : i + 4096, None] * a + b) % p) & low).min(0))
            return x.astype(np.int64)

        return rows.map(one)

    return sign(hashes)


def with_signature(df: DataFrame, hashes: str, out: str = "signature", n: int = PERMUTATIONS, seed: int = SEED) -> DataFrame:
    """Adds the signature as a column of its own, in Arrow batches, so that later expressions can be anything."""
    import pyarrow as pa

    a, b = coefficients(n, seed)
    p, low = np.uint64((1 << 61) - 1), np.uint64(0xFFFFFFFF)

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(hashes)
            signed = []
            for h in batch.column(i):
                v = np.asarray(h.values.to_numpy(zero_copy_only=False) if h.is_valid else [], np.uint64)
                x = np.full(n, 0xFFFFFFFF, np.uint64)
                for j in range(0, len(v), 4096):
                    y = v[j : j + 4096, None] * a + b
                    y = (y & p) + (y >> np.uint64(61))  # modulo 2^61 - 1, up to one p
                    x = np.minimum(x, ((y - p * (y >= p)) & low).min(0))
                signed.append(x.astype(np.int64) if len(v) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed, pa.list_(pa.int64()))], [*batch.schema.names, out])

    from pyspark.sql.types import ArrayType, LongType, StructType

    return df.mapInArrow(run, StructType(list(df.schema.fields)).add(out, ArrayType(LongType())))


def buckets(bands: int, rows: int, signature: str = "signature") -> Column:
    """A bucket for each band.  Sets without shingles have no signature: leave them out before."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice(signature, i * rows + 1, rows)))


def lsh_pairs(banded: DataFrame) -> DataFrame:
    """Candidate pairs a < b of (key, band, bucket) that share a bucket: all of them, however crowded."""
    x, y = banded.withColumnRenamed("key", "a"), banded.withColumnRenamed("key", "b")
    return x.join(y, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def shingle_sets(df: DataFrame, key: str, text: str, kind: str, k: int = 5, least: int = 8) -> DataFrame:
    """key, kind and ``s``: sorted 64-bit hashes of a canonical text's distinct word k-grams, with the kind hashed in.

    Only sets of one kind can share a hash; a set without kind becomes one hash, which equal ones without kind share.  Arrow batches: words are hashed once in a while, k-grams as vectors.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructType

    d = df.select(key, kind, text)

    def run(batches):
        known = _Words()
        for batch in batches:
            sets = []
            for t, c in zip(batch.column(2), batch.column(1)):
                w = (t.as_py() or "").encode().split()
                if len(w) < max(k, least):
                    sets.append(np.empty(0, np.int64))
                    continue
                if len(known) > 1 << 17:
                    known.clear()
                v = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                h = np.full(len(w) - k + 1, _digest(repr(c.as_py()).encode()), np.uint64)
                for j in range(k):
                    h = _mixed(h + v[j : len(w) - k + 1 + j])
                u = np.unique(h.view(np.int64))
                sets.append(u if c.is_valid else np.array([_digest(u.tobytes())], np.uint64).view(np.int64))
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            s = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], [key, kind, "s"])

    return d.mapInArrow(run, StructType(list(d.schema.fields)[:2]).add("s", ArrayType(LongType())))


def _digest(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = _digest(w)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(d: DataFrame, key: str, shingles: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (k, s) under their least key, and the copies (a, b) with it; the sets are written once."""
    s = F.col(shingles) if d.schema[shingles].dataType.simpleString() == "array<bigint>" else F.transform(shingles, lambda v: F.xxhash64(v))
    x = reliable(d.where(F.size(shingles) > 0).select(F.col(key).alias("k"), F.array_sort(F.array_distinct(s)).alias("s")).withColumn("h", F.struct(F.xxhash64("s"), F.xxhash64(F.lit(7), "s"), F.size("s"))))
    least = x.groupBy("h").agg(F.min("k").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    same = reliable(x.select("k", "h").join(least, "h").where("k <> a").select("a", F.col("k").alias("b")))
    return x.drop("h").join(_few(same.select(F.col("b").alias("k"))), "k", "left_anti"), same


def _few(df: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast where it is under ``KEYS`` rows."""
    return F.broadcast(df) if df.count() <= KEYS else df


def _prefixes(g: DataFrame, threshold: float) -> DataFrame:
    """(v, k, n): of a set's n hashes those of which a similar set shares one, without hashes that no other set gives.

    Of a set in a fixed order the first n - ceil(t n) + 1 must hold one of any
    similar set's.  The order is that of the hashes; where that brings crowds
    (more than ``CROWD`` sets), crowded hashes are put last, for all sets alike.
    """
    first = lambda o: F.slice(o, F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int"))

    def met(pre: DataFrame) -> DataFrame:
        pre = pre.repartition("v")  # one shuffle for count and join
        m = pre.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
        return reliable(pre.join(m, "v"))

    plain = g.withColumn("n", F.size("s"))
    pre = plain.select("k", "n", F.explode(first("s")).alias("v"))
    rows = met(pre)
    late = fresh = reliable(rows.where(F.col("m") > CROWD).groupBy("v").agg(F.first("m").alias("m")))
    if fresh.isEmpty():
        return rows.drop("m")
    for _ in range(CROWD_ROUNDS):
        # a hash that is put last moves nothing in sets that hold it behind their prefix
        hit = plain.select("k", F.explode("s").alias("v")).join(_few(late), "v").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("c"))
        moved = plain.join(hit, "k", "left").withColumn("o", F.when(F.col("c").isNull(), F.col("s")).otherwise(F.concat(F.array_except("s", "c.v"), "c.v")))
        pre = moved.select("k", "n", F.explode(first("o")).alias("v"))
        rows = met(pre)
        fresh = reliable(rows.where(F.col("m") > CROWD).groupBy("v").agg(F.first("m").alias("m")).join(late, "v", "left_anti").select("v", "m"))
        if fresh.isEmpty():
            break
        late = reliable(late.union(fresh))
    return rows.drop("m")


def measured(c: DataFrame, g: DataFrame) -> DataFrame:
    """(a, b, jaccard) of written pairs; only sets that pairs name are moved."""
    named = reliable(c.select(F.col("a").alias("k")).union(c.select("b")).distinct())
    g = g.join(_few(named), "k", "left_semi")
    side = lambda s: g.select(F.col("k").alias(s), F.col("s").alias(f"s{s}"))
    return c.join(side("a"), "a").join(side("b"), "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


def _alike(na: str, nb: str, threshold: float) -> Column:
    return F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold)


def all_pairs(d: DataFrame, key: str, shingles: str, threshold: float) -> DataFrame:
    """All pairs a < b with shingle Jaccard of at least ``threshold``: (a, b, jaccard), exact; copies have their pairs too.

    Shingles are strings, or 64-bit hashes.  Pairs are found between classes of equal sets (see ``similar``) and
    expanded as they are read.
    """
    return similar.expanded(*similar.similar(d, key, shingles, threshold))


def similar_pairs(d: DataFrame, key: str, shingles: str, threshold: float) -> DataFrame:
    """``all_pairs`` in short: the pairs of the least keys of equal sets, and each copy's pair of 1 with its least key.

    A copy's other pairs are those of its least key and aren't repeated: what counts pairs needs ``all_pairs`` or ``weighed``.
    """
    members, pairs = similar.similar(d, key, shingles, threshold)
    return pairs.union(members.where("k <> c").select(F.col("c").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("jaccard")))


def similar_roots(d: DataFrame, key: str, shingles: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the similarity graph, and the similar pairs (a, b, jaccard) of roots with their nodes.

    The clusters of ``similar_pairs`` without its pairs: sets that meet are first
    compared with the least of them, and only sets that are then still in several
    clusters with each other.  Copies stand in the pairs as there.
    """
    g, same = _folded(d, key, shingles)
    pre = _prefixes(g, threshold)
    least = pre.groupBy("v").agg(F.min(F.struct("k", "n")).alias("l"))
    c = pre.join(least, "v").select(F.col("l.k").alias("a"), F.col("k").alias("b"), F.col("l.n").alias("na"), F.col("n").alias("nb"))
    tried = reliable(c.where((F.col("a") < F.col("b")) & _alike("na", "nb", threshold)).select("a", "b").distinct())
    links = reliable(measured(tried, g).where(F.col("jaccard") >= threshold).select("a", "b"))
    at = pre.join(components(links).toDF("k", "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    several = at.groupBy("v").agg(F.min("root").alias("main"), F.max("root").alias("_last")).where("main < _last").drop("_last")
    at = reliable(at.join(several, "v"))  # of two sets in different clusters one is outside the group's main one
    x = at.where("root <> main").select("v", F.col("k").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"))
    y = at.select("v", F.col("k").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"))
    c = x.join(y, "v").where((F.col("rx") != F.col("ry")) & _alike("nx", "ny", threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = measured(reliable(c.join(tried, ["a", "b"], "left_anti").select("a", "b")), g).where(F.col("jaccard") >= threshold).select("a", "b")
    roots = components(links.union(more).union(same))
    stars = reliable(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).join(same.select("b"), "b", "left_anti").select("a", "b"))
    return roots, measured(stars, g).where(F.col("jaccard") >= threshold).union(same.withColumn("jaccard", F.lit(1.0)))


def near_clusters(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the similarity graph at a threshold."""
    return components(pairs.where(F.col("jaccard") >= threshold))


def near_decisions(nodes: DataFrame, clusters: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Decision rows of clustered nodes: the similarity is the measured one to the representative, or the threshold.

    A copy has the similarity of the least key with its set, which ``pairs`` need not repeat for it.
    """
    c = clusters.union(clusters.select("root", "root").distinct()).toDF("key", "representative").distinct()
    p = pairs.select(F.col("a").alias("representative"), F.col("b").alias("_of"), "jaccard")
    copies = pairs.where("jaccard = 1").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("_least"))
    out = nodes.join(c, "key").join(copies, "key", "left").withColumn("_of", F.coalesce("_least", "key"))
    out = out.join(p, ["representative", "_of"], "left").withColumn("jaccard", F.when(F.col("_of") == F.col("representative"), 1.0).otherwise(F.col("jaccard")))
    lead = F.col("key") == F.col("representative")
    return out.select("key", "representative", F.concat(F.lit("near:"), F.substring(F.sha2(F.col("representative").cast("string"), 256), 1, 16)).alias("cluster_id"), F.when(lead, "representative").otherwise("member").alias("role"), F.when(lead, 1.0).otherwise(F.coalesce("jaccard", F.lit(threshold))).alias("similarity"))


def merged(idx: DataFrame, near: DataFrame, multi: DataFrame | None = None) -> DataFrame:
    """One decision for each record: exact before near before several sources before unique; all rows stay."""
    e = exact(idx)
    n = near.select(F.col("key").alias("record_id"), F.col("representative").alias("_nr"))
    out = e.join(n, "record_id", "left")
    in_exact, in_near = F.col("cluster_id").isNotNull(), F.col("_nr").isNotNull()
    stage = F.when(in_exact, "exact").when(in_near, "near")
    if multi is not None:
        out = out.join(multi.select("record_id", F.lit(True).alias("_m")), "record_id", "left")
        stage = stage.when(F.col("_m"), "identity")
    lead = F.when(in_exact, F.col("representative.record_id")).when(in_near, F.col("_nr")).otherwise(F.col("record_id"))
    return out.select("source_id", "record_id", "content_type", stage.otherwise("unique").alias("dedup_stage"), lead.alias("representative_id"), (lead == F.col("record_id")).alias("dedup_keep"))


def sweep(pairs: DataFrame, labelled: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and recall of the pairs' similarity against labels (a, b, label), for each threshold."""
    s = labelled.join(pairs.select("a", "b", "jaccard"), ["a", "b"], "left").select("label", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), F.lit(1).alias("pairs"))
    return swept(s, thresholds)


def swept(counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision and recall for each threshold, of (jaccard, label, pairs): so many pairs have this similarity and label."""
    t = counts.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    n = lambda met, label: F.coalesce(F.sum(F.when(met & (F.col("label") == label), F.col("pairs"))), F.lit(0)).cast("long")
    over = F.col("jaccard") >= F.col("threshold")
    g = counts.crossJoin(F.broadcast(t)).groupBy("threshold").agg(n(over, 1).alias("tp"), n(over, 0).alias("fp"), n(~over, 1).alias("fn"))  # thresholds: a handful of literals
    return g.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
