"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the session's shared folder (a temporary one only where none is set)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates two star contractions until nothing changes: every node hangs its
    larger neighbours, then itself, under the smallest node near it.  Minima are
    combined before each shuffle; the number of rounds grows with the logarithm
    of a component's size.
    """
    e = reliable(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = reliable(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(now)


#: Whether Spark deletes a query's shuffle files when it ends, and not when the driver collects garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the session's shared folder; the shuffle files of making it go at once."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="siltstone-")
    path, before = f"{at.rstrip('/')}/stored-{uuid.uuid4().hex}", spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
