"""Pairs of similar sets, all of them, without writing the sets.

Sets are eight times as many bytes as a text has words, so they are made anew from their table for each step, and only
keys, digests and pairs are written.  Equal sets are one class under its least key; classes meet by prefixes in rounds of
hash ranges, so that only a part of the prefixes is on disk at a time; sets of the pairs that met then travel to groups
of blocks, once for a block and not once for a pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .graph import erase, stored

#: Hashes of more sets are crowded; as many are put last at most.  A table of more keys is not broadcast.
CROWD, KEYS = 50, 1 << 19
#: Similar sets of n hashes have to share 1 + n / DEPTH in their prefixes, which are longer by n / DEPTH for it.
DEPTH = 16
#: Crowds are looked for in the prefixes of one class of so many.
SHARE = 16
#: Shuffled bytes of prefixes that make a round, most rounds, bytes of a prefix row.
ROUND_BYTES, ROUNDS, ROW_BYTES = 64 << 20, 4, 16
#: Sets of a block, and sets that are compared in one group.
BLOCK, GROUP = 64, 512
#: Rows cut or pairs made at a time.
ROWS, PAIRS = 512, 1 << 18


def hashed(d: DataFrame, key: str, shingles: str) -> DataFrame:
    """(k, s): sorted distinct 64-bit hashes of each set that has a key and is not empty."""
    if isinstance(d.schema[shingles].dataType.elementType, LongType):
        s = F.col(shingles)
    else:
        s = F.transform(shingles, lambda v: F.xxhash64(v))
    return d.where(F.col(key).isNotNull() & (F.size(shingles) > 0)).select(F.col(key).alias("k"), F.sort_array(F.array_distinct(s)).alias("s"))


def classes(digests: DataFrame) -> DataFrame:
    """(c, k, n), written: the least key with an equal set, a key, and the set's size, of (k, h, n) with the digest h."""
    x = stored(digests)
    least = x.groupBy("h").agg(F.min("k").alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
    out = stored(x.join(least, "h", "left").select(F.coalesce("c", "k").alias("c"), "k", "n"))
    erase(x)
    return out


def digest(s: str = "s"):
    """What sorted sets are told apart by: two hashes and the size."""
    return F.struct(F.xxhash64(s), F.xxhash64(F.lit(7), s), F.size(s))


def leads(sets: DataFrame, members: DataFrame) -> DataFrame:
    """The sets of the least keys; the shorter list of keys is broadcast, so that sets stay where they are."""
    copies, firsts = members.where("k <> c").select("k"), members.where("k = c").select("k")
    m, n = copies.count(), firsts.count()
    if m == 0:
        return sets
    if m <= min(n, KEYS):
        return sets.join(F.broadcast(copies), "k", "left_anti")
    return sets.join(F.broadcast(firsts) if n <= KEYS else firsts, "k", "left_semi")


def least(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many hashes a set of n has in common with a similar one at least."""
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def prefixes(sets: DataFrame, threshold: float, late: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 1, this: int = 0, share: int = 1) -> DataFrame:
    """(v, k, n): the first n - ceil(t n) + l hashes of each set of n, of which any similar set's first ones hold l.

    l is 1 + n / ``DEPTH``; of a pair it is the lesser one, or all that the pair has in common if that is less still.
    It holds in any order that is the same for all sets: here that of the hashes, with those of ``late`` (sorted hashes and
    their ranks) last by rank.  Only hashes of the range ``this`` of ``rounds`` come out, and only sets whose least hash is one of ``share``.
    """
    held = sets.sparkSession.sparkContext.broadcast(late) if late is not None else None
    kind = sets.schema["k"]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                lists = batch.column(1)
                off = lists.offsets.to_numpy()
                v, off = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], (off - off[0]).astype(np.int64)
                n = np.diff(off)
                row = np.repeat(np.arange(len(n)), n)
                if held is not None:
                    names, ranks = held.value
                    at = np.minimum(np.searchsorted(names, v), len(names) - 1)
                    v = v[np.lexsort((np.where(names[at] == v, ranks[at], 0), row))]
                first = n - least(n, threshold) + 1 + n // DEPTH
                keep = np.arange(len(v)) - off[row] < first[row]
                if rounds > 1:
                    keep &= (v.view(np.uint64) >> np.uint64(33)) % np.uint64(rounds) == this
                if share > 1:
                    keep &= (v[off[:-1]].view(np.uint64) % np.uint64(share) == 0)[row]
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]), batch.column(0).take(pa.array(row[keep])), pa.array(n[row[keep]].astype(np.int32))], ["v", "k", "n"])

    return sets.mapInArrow(run, StructType([StructField("v", LongType()), StructField("k", kind.dataType), StructField("n", IntegerType())]))


def crowds(sets: DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted hashes that are crowded in prefixes, with ranks by frequency, judged on a share of the sets.

    They only choose the order of prefixes; with any order the same pairs are found.
    """
    seen = prefixes(sets, threshold, share=SHARE).groupBy("v").agg(F.count("*").alias("m")).where(F.col("m") > max(2, CROWD // SHARE))
    top = seen.orderBy(F.desc("m"), "v").limit(KEYS).toPandas()
    if not len(top):
        return None
    v, rank = top["v"].to_numpy(), len(top) - np.arange(len(top))
    o = np.argsort(v)
    return v[o], rank[o]


def meeting(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, need, m), a < b, of (v, k, n): how many v they share, of ``need`` for a similar pair, where their sizes allow one."""
    kind = rows.schema["k"].dataType

    def run(batches):
        v, k, n = (np.empty(0, t) for t in (np.int64, object, np.int64))
        for batch in batches:
            x, y, z = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(x) == 0:
                continue
            v, k, n = np.concatenate([v, x]), np.concatenate([k, y]) if len(k) else y, np.concatenate([n, z])
            cut = int(np.searchsorted(v, v[-1]))  # the last hash may go on in the next batch
            yield from joined(v[:cut], k[:cut], n[:cut])
            v, k, n = v[cut:], k[cut:], n[cut:]
        yield from joined(v, k, n)

    def joined(v, k, n):
        i, step = np.arange(len(v)), 0
        while len(i):
            step += 1
            i = i[i + step < len(v)]
            i = i[v[i] == v[i + step]]
            for j in range(0, len(i), PAIRS):
                x = i[j : j + PAIRS]
                y = x + step
                low, high = np.minimum(n[x], n[y]), least(np.maximum(n[x], n[y]), threshold)
                like = low >= high
                p, q = k[x[like]], k[y[like]]
                less, need = p < q, np.minimum(1 + low // DEPTH, high)[like].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(less, p, q), type=arrow), pa.array(np.where(less, q, p), type=arrow), pa.array(need)], ["a", "b", "need"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    pairs = rows.repartition("v").sortWithinPartitions("v").mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind), StructField("need", IntegerType())]))
    return pairs.groupBy("a", "b", "need").agg(F.count("*").alias("m"))


def candidates(sets: DataFrame, threshold: float, shingles: int) -> DataFrame:
    """(a, b), written: the pairs that share enough of their prefixes; ``shingles``: how many all sets have together."""
    late = crowds(sets, threshold)
    rounds = int(min(ROUNDS, max(1, shingles * (1 - threshold) * ROW_BYTES // ROUND_BYTES)))
    met = [meeting(prefixes(sets, threshold, late, rounds, i), threshold) for i in range(rounds)]
    if rounds > 1:
        met = [stored(x) for x in met]
    out = stored(reduce(DataFrame.union, met).groupBy("a", "b", "need").agg(F.sum("m").alias("m")).where("m >= need").select("a", "b"))
    if rounds > 1:
        erase(*met)
    return out


def compared(pairs: DataFrame, sets: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a, b, jaccard), written, of written distinct pairs with at least the threshold.

    A key is put beside its least partner's others, in blocks of about ``BLOCK`` keys; a set goes once to each group of
    block pairs that needs it.  More groups than ``KEYS`` sets fill are taken in turns.
    """
    low = pairs.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("l"))
    nodes = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct().join(low, "k", "left").withColumn("l", F.coalesce("l", "k"))
    nodes = stored(nodes)
    blocks = nodes.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).alias("q"))
    at = stored(nodes.join(blocks, "l").select("k", F.xxhash64("l", F.pmod(F.xxhash64("k"), "q")).alias("w")))
    beside = pairs.join(at.toDF("a", "wa"), "a").join(at.toDF("b", "wb"), "b").select("a", "b", F.xxhash64(F.least("wa", "wb"), F.greatest("wa", "wb")).alias("w"))
    groups = max(1, at.count() // GROUP)
    beside = stored(beside.withColumn("w", F.pmod("w", F.lit(groups))))
    needs = stored(beside.select("w", F.col("a").alias("k")).union(beside.select("w", "b")).distinct())
    turns = -(-needs.count() // KEYS) or 1
    kind = pairs.schema["a"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("jaccard", DoubleType())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {k.as_py(): s.values.to_numpy(zero_copy_only=False) for k, s in zip(left["k"], left["s"])}
        likeness = np.empty(len(right))
        for i, (a, b) in enumerate(zip(right["a"].to_pylist(), right["b"].to_pylist())):
            x, y = own[a], own[b]
            z = np.concatenate([x, y])
            z.sort()
            both = int((z[1:] == z[:-1]).sum())
            likeness[i] = both / (len(z) - both)
        out = pa.table({"a": right["a"], "b": right["b"], "jaccard": likeness})
        return out.filter(pa.array(likeness >= threshold))

    done = []
    for i in range(turns):
        turn = lambda t: t.where(F.col("w") % turns == i) if turns > 1 else t  # noqa: B023, E731
        moved = sets.join(F.broadcast(turn(needs)), "k").select("w", "k", "s")
        done.append(stored(moved.groupBy("w").cogroup(turn(beside).groupBy("w")).applyInArrow(compare, schema)))
    erase(nodes, at, beside, needs)
    return reduce(DataFrame.union, done)


def similar(d: DataFrame, key: str, shingles: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (c, k, n) of the classes of equal sets, and the pairs (a, b, jaccard) of least keys of similar classes, both written."""
    sets = hashed(d, key, shingles)
    members = classes(sets.select("k", digest().alias("h"), F.size("s").alias("n")))
    sets = leads(sets, members)
    met = candidates(sets, threshold, members.where("k = c").agg(F.sum("n")).first()[0] or 0)
    out = compared(met, sets, threshold)
    erase(met)
    return members, out


def expanded(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of keys, of pairs of classes and within classes."""
    m = members.select("c", "k")
    one, two = m.toDF("a", "x"), m.toDF("b", "y")
    across = pairs.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    within = m.toDF("c", "a").join(m.toDF("c", "b"), "c").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return across.union(within)


def weighed(members: DataFrame, pairs: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(jaccard, label, pairs): how many pairs of keys have a similarity and a difference of sizes (k, x) up to ``most`` (label 1) or not.

    Counted by classes and their distinct sizes, so that copies don't become pairs.  Keys without size have no label.
    """
    h = stored(members.join(sizes, "k").groupBy("c", "x").agg(F.count("*").alias("m")))
    side = lambda s: h.select(F.col("c").alias(s), F.col("x").alias(f"x{s}"), F.col("m").alias(f"m{s}"))
    label = (F.abs(F.col("xa") - F.col("xb")) <= most).cast("int").alias("label")
    across = pairs.join(side("a"), "a").join(side("b"), "b").select("jaccard", label, (F.col("ma") * F.col("mb")).alias("pairs"))
    copied = h.groupBy("c").agg(F.sum("m").alias("t")).where("t > 1").select("c")
    own = stored(h.join(copied, "c"))
    twice = own.toDF("c", "xa", "ma").join(own.toDF("c", "xb", "mb"), "c").where("xa <= xb or (xa <=> xb) or xa is null")
    number = F.when(F.col("xa") < F.col("xb"), F.col("ma") * F.col("mb")).otherwise(F.expr("ma * (ma - 1) div 2"))
    return across.union(twice.select(F.lit(1.0).alias("jaccard"), label, number.alias("pairs")))
