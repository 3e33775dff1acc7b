"""A training corpus from ``documents`` in five stages.

Each stage takes all that its predecessor kept, as Parquet, and all but the last
return the columns of ``documents``.  ``run`` writes each stage's rows to the
shared folder and reads them again.  ORACLE_SQL is None: neighbours under TF-IDF
cosine and byte passages have no SQL form.

In all stages null texts are empty, null ids stay null, repeated rows are judged
each, other columns go along unchanged whatever their names, and an empty table
gives no rows.  Executors hand back unused heap before a stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontamination, packing, partenum, suffixes, toxicity
from siltstone.llm.common import slim, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; empty texts are judged by the share of such examples."""
    slim(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join; texts without words are in none and stay."""
    slim(spark)
    return partenum.keep_first(docs)


def repeated_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that a smaller document holds; rows without an id lose nothing."""
    slim(spark)
    return suffixes.deduplicated(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; empty texts hold none."""
    slim(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents' tokens, dealt into sequences of at most 1024."""
    slim(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("suffix_array_dedup", repeated_passages_out),
    ("benchmark_decontamination", leaks_out),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
