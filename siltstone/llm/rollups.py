"""Token counts as delta-maintained rollups.

A change feed holds signed images of documents: an insert adds its count, a
delete takes it away, a revision does both (the count before, the count after).
A batch of changes is summed by source, language and tokenizer version, combined before
its shuffle (so a hot source costs a row per task), and committed as one small delta.
Totals are the sum of committed deltas, so they are additive, and old deltas
compact into one.

A commit is a single marker file, made after the delta is written and named by
the batch.  A batch that is sent again finds its marker and changes nothing; a
batch that died half-way has no marker and is written anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import chunks, mapped, scratch_path, written

KEYS = ["source", "lang", "tokenizer"]
#: Name of the marker that stands for a list of batches.
MANY = "many"
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def changes(df: DataFrame, kind: Column | str, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Rows with ``kind`` insert, delete or revise, ``before`` and ``after`` counts and versions, as signed images.

    ``before`` and ``after`` are structs of (tokenizer, tokens).
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    gone, come = kind.isin("delete", "revise"), kind.isin("insert", "revise")
    none = F.lit(None).cast("struct<tokenizer:string,tokens:long>")
    image = lambda on, s, sign: F.when(on, F.struct(F.lit(sign).cast("long").alias("sign"), s["tokenizer"].alias("tokenizer"), s["tokens"].cast("long").alias("tokens")))
    both = F.array_compact(F.array(image(gone, before if before is not None else none, -1), image(come, after if after is not None else none, 1)))
    return df.select("source", "lang", F.explode(both).alias("c")).select("source", "lang", "c.*")


class Rollup:
    """Totals by source, language and tokenizer version in a folder of committed deltas.

    Null sources, languages and versions are values of their own, null counts
    are 0, repeated rows count each, and an empty batch is committed too.  Only
    the named columns of a batch are read; others may have any name.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or scratch_path(spark, "rollup")).rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Committed batches and the delta folder of each."""
        fs, top = self._fs(), self._path("commits")
        if not fs.exists(top):
            return {}
        marks = [s.getPath().getName().rpartition("@") for s in fs.listStatus(top)]
        out = {batch: delta for batch, _, delta in marks if batch != MANY}
        lists = [(self._listed(delta), delta) for batch, _, delta in marks if batch == MANY]
        for names, delta in sorted(lists, key=lambda x: (len(x[0]), x[1])):  # of two compactions the later one holds the earlier
            out |= dict.fromkeys(names, delta)
        return out

    def _listed(self, delta: str) -> list[str]:
        return [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/lists/{delta}").collect()]

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Apply a batch of signed images (source, lang, tokenizer, tokens, sign) once; False if it was committed before."""
        if not batch or set("/@") & set(batch) or batch == MANY:
            raise ValueError(f"a batch name has none of / @ and isn't {MANY}")
        if batch in self.batches():
            return False
        delta = uuid.uuid4().hex
        summed = signed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).alias("tokens"))
        summed.where("docs <> 0 or tokens <> 0").write.parquet(f"{self.folder}/deltas/{delta}")
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        if batch in self.batches():
            return False
        fs.create(self._path(f"commits/{batch}@{delta}"), False).close()
        return True

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents are all gone don't appear."""
        deltas = sorted(set(self.batches().values()))
        if not deltas:
            return self.spark.createDataFrame([], SCHEMA)
        d = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/deltas/{x}" for x in deltas))
        return d.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Replace all deltas by their sum.

        The sum and the list of the batches it holds are written first, then one
        marker for them, then the old markers go.  ``batches`` lets that marker
        stand for the listed batches, so a crash in between changes nothing.
        """
        done = self.batches()
        if len(set(done.values())) < 2:
            return
        delta = uuid.uuid4().hex
        self.totals().coalesce(1).write.parquet(f"{self.folder}/deltas/{delta}")
        self.spark.createDataFrame([(b,) for b in sorted(done)], "batch string").coalesce(1).write.parquet(f"{self.folder}/lists/{delta}")
        fs = self._fs()
        fs.create(self._path(f"commits/{MANY}@{delta}"), False).close()
        for s in fs.listStatus(self._path("commits")):
            if s.getPath().getName().rpartition("@")[2] != delta:
                fs.delete(s.getPath(), False)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.MemoTokenizer(path)
        for part, _, _ in chunks(batches, "text", bpe.TEXT_BYTES):
            _, off = tok.encode([t or "" for t in part.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(off), pa.int64())], [*part.schema.names[1:], "tokens"])

    return run


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """source, lang, empty and tokens of every document, by the byte-level BPE vocabulary.

    Null texts are empty and have no tokens; repeated rows are counted each; an
    empty table gives no rows; other columns are ignored.
    """
    d = docs.select("text", "source", "lang", (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"))
    return d.transform(mapped(_counter(vocabulary or bpe.default_path()), "source string, lang string, empty boolean, tokens long"))


def op3_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Token totals of all documents after four batches.

    All documents are inserted with their BPE counts (version 1); all are
    revised to version 2, which counts an end token too; empty texts are
    deleted; the revision is sent a second time, to no effect.  Columns: source,
    lang, tokenizer, docs, tokens.
    """
    d = written(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rollup-counts")
    v1 = F.struct(F.lit("byte_bpe_50k/1").alias("tokenizer"), F.col("tokens").alias("tokens"))
    v2 = F.struct(F.lit("byte_bpe_50k/2").alias("tokenizer"), (F.col("tokens") + 1).alias("tokens"))
    r = Rollup(spark)
    r.commit("load", changes(d, "insert", after=v1))
    r.commit("version-2", changes(d, "revise", before=v1, after=v2))
    r.commit("drop-empty", changes(d.where("empty"), "delete", before=v2))
    r.commit("version-2", changes(d, "revise", before=v1, after=v2))
    return r.totals()
