"""Streaming variants of batch operators; on the same finite input they give the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pii


def index_stream(docs: DataFrame, record: str, text: str) -> DataFrame:
    """Canonical text and digest of a stream of records; stateless."""
    d = T.canonical(docs, text, "canonical")
    return d.select(record, "canonical", "transforms", F.sha2("canonical", 256).alias("canonical_sha256"))


def first_copies(docs: DataFrame, record: str, text: str, time: str, delay: str) -> DataFrame:
    """The first copy of each canonical text within the watermark; state is dropped behind it."""
    d = docs.withWatermark(time, delay).withColumn("canonical_sha256", F.sha2(F.col(text), 256))
    return d.dropDuplicatesWithinWatermark(["canonical_sha256"]).select(record, time, "canonical_sha256")


def secret_counts(docs: DataFrame, text: str, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Findings by window and type."""
    f = pii.findings(docs.withWatermark(time, delay), [time], text)
    return f.groupBy(F.window(time, window), "type").agg(F.count("*").alias("findings"))


def event_counts(events: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and sum by tumbling window and kind; late rows behind the watermark are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
