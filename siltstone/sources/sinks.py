"""Sinks: JSON lines with sorted keys, written aside and renamed, with a digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, order: list[str]) -> int:
    """Writes rows in ``order`` as JSON lines with sorted keys: to a folder aside, then renamed.  Returns the count.

    Part files follow each other in order, so the whole is sorted without one
    task holding it.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    rows = df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.text(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    src, dst = hadoop.Path(aside), hadoop.Path(path)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(dst, True)
    if not fs.rename(src, dst):
        raise OSError(f"can't rename {aside}")
    return spark.read.text(path).count()


def digest(df: DataFrame) -> str:
    """SHA-256 over the rows' canonical JSON hashes in order of hash: equal for equal sets of rows."""
    h = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    return h.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]
