"""The pipeline's stages on a small fixture and its result on the smallest tables."""

import corpus_pipeline as pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        out = pipeline.written(stage(spark, docs, sf), name)
        assert out.schema == docs.schema
        after = [r.doc_id for r in out.collect()]
        assert len(after) == len(set(after)) and set(after) <= before and len(after) > 0.7 * len(before)
        if name == "suffix_array_dedup":
            assert set(after) == before
        docs, before = out, set(after)
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == before


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
