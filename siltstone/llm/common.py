"""Shared plumbing of the llm operators: scratch tables, arrow chunks, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import _broadcastRegistry
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20

with contextlib.suppress(OSError, AttributeError):
    # Worker processes live on between tasks.  With a fixed threshold (M_MMAP_THRESHOLD, -3) the C library maps every
    # large array by itself and gives it back when it is freed, instead of keeping it in a heap that only grows.
    # Arrow's buffers come from it too, and threads share one arena (M_ARENA_MAX, -8).
    ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)
    ctypes.CDLL("libc.so.6").mallopt(-8, 1)
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """At the end of a task: let go of the values of broadcasts, which are read again if need be, and return freed memory to the system."""
    for b in list(_broadcastRegistry.values()):
        if b._path is not None:
            b.__dict__.pop("_value", None)
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)

#: Edges of a forest that one task unites: 4 MB of them.
ONE_TASK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder is made and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.siltstone.scratch", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.siltstone.scratch", path)
    return path.rstrip("/")


def slim(spark: SparkSession) -> None:
    """Let executors' JVMs collect garbage and hand unused heap back, so that the next stage's Python workers have room beside it.

    Twice as many short tasks as there are cores reach every executor; one that
    is missed only keeps its heap.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, unique to this call."""
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when it ends, and not when the driver collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, swept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.  ``swept``: its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    small_batches(spark)
    before = spark.conf.get(SWEEP, None)
    if swept:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if swept:
            spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system (driver side)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut arrow batches into row slices of about ``most`` text bytes.

    A slice holds at least one row, so one long text is never cut.
    """
    for batch in batches:
        buf, off = flat(batch.column(batch.schema.get_field_index(text)))
        n, a = batch.num_rows, 0
        while a < n:
            b = int(np.searchsorted(off, off[a] + most, "right")) - 1
            b = min(n, max(b, a + 1))
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


#: Bytes of an Arrow batch between the JVM and Python: each stands in both memories, outside the JVM's heap.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES`` from now on, unless the session has a limit of its own below 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def mapped(run: Callable[[Iterator], Iterator], schema) -> Callable[[DataFrame], DataFrame]:
    """``mapInArrow`` in small batches; a task gives its memory back when it has ended and holds nothing any more."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    def on(df: DataFrame) -> DataFrame:
        small_batches(df.sparkSession)
        return df.mapInArrow(whole, schema)

    return on


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Join small arrow batches, and cut large ones, to about ``most`` text bytes."""
    kept, size = [], 0
    for part, buf, _ in chunks(batches, text, most):
        if kept and size + len(buf) > most:
            t = pa.Table.from_batches(kept)
            yield (t, *flat(t.column(text)))
            kept, size = [], 0
        kept.append(part)
        size += len(buf) + 16 * part.num_rows
    if kept:
        t = pa.Table.from_batches(kept)
        yield (t, *flat(t.column(text)))


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges (a, b): every node but a root, with its component's smallest node."""
    nodes, flat_ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = flat_ends[: len(a)], flat_ends[len(a) :]
    while True:
        lx, ly = label[x], label[y]
        low = np.minimum(lx, ly)
        new = label.copy()
        np.minimum.at(new, lx, low)
        np.minimum.at(new, ly, low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    va, vb, size = [], [], 0
    def out():
        a, b = forest(np.concatenate(va), np.concatenate(vb))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    for x in batches:
        va.append(x.column(0).to_numpy())
        vb.append(x.column(1).to_numpy())
        size += x.num_rows
        if size > 1 << 21:
            yield out()
            va, vb, size = [], [], 0
    if size:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as (node, root): root is the smallest node.

    Each task first shrinks its edges to a spanning forest.  Up to ``ONE_TASK``
    edges, counted, one task unites them; otherwise large-star and small-star
    steps alternate.  Each step is a grouped minimum, combined before
    the shuffle, and a join that adaptive execution splits when a hub is hot.
    Nodes without an edge do not appear.  The edges of each round are written to
    the shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a <> b").transform(mapped(_forests, "a long, b long")).distinct()
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
    if e.count() <= ONE_TASK:
        whole = e.coalesce(1).transform(mapped(_forests, "a long, b long"))
        return whole.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(now) == tuple(seen):
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
