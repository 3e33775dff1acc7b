"""Readers, sinks, lineage and streaming variants on small files."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lineage
from siltstone.sources import readers, sinks
from siltstone.streaming import variants


def test_json_lines_and_bad_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{bad\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path), "a int").collect()] == [1, 2]
    d = readers.json_lines(spark, str(tmp_path), "a int", keep_bad=True).cache()
    assert readers.malformed(d).first().malformed == 1


def test_json_folder(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "CVE-1.json").write_text(json.dumps({"id": "CVE-1"}))
    (tmp_path / "other.json").write_text("{}")
    assert [r.id for r in readers.json_folder(spark, str(tmp_path), "CVE-*.json", "id string").collect()] == ["CVE-1"]


def test_xml_and_stix(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<C xmlns="u"><W ID="1" Name="n"><D>text</D><R a="1"/><R>two</R></W><W ID="2">t</W></C>')
    rows = [json.loads(r.content) for r in readers.xml_records(spark, str(tmp_path / "c.xml"), "W").collect()]
    assert rows[0] == {"@attributes": {"ID": "1", "Name": "n"}, "D": "text", "R": [{"@attributes": {"a": "1"}}, "two"]}
    assert readers.flatten_text(rows[0]) == "text\ntwo"
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "objects": [{"type": "malware", "id": "m--1"}]}))
    assert [tuple(r)[:2] for r in readers.stix_objects(spark, str(tmp_path / "b.json")).collect()] == [("stix_malware", "m--1")]


def test_snapshot_guards(spark):
    pages = spark.createDataFrame([(0,), (10,)], "start long")
    assert readers.complete(pages, 20, 10).count() == 2
    with pytest.raises(ValueError):
        readers.complete(pages, 21, 10)


def test_sink_is_ordered_and_digest_is_not(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "ä")], "k int, a string")
    assert sinks.json_lines(df, str(tmp_path / "out"), ["k"]) == 3
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines)[0].startswith('{"a":') and len(lines) == 3
    assert sinks.digest(df) == sinks.digest(df.orderBy(F.desc("k"))) != sinks.digest(df.limit(2))


def test_lineage_strict(spark):
    df = spark.createDataFrame([("a", "r")], "source_id string, record_id string")
    v = df.withColumn("violations", lineage.violations(df, {}, ["source_id", "record_id"]))
    assert lineage.strict(v).count() == 1
    bad = df.withColumn("source_id", F.lit(" "))
    with pytest.raises(Exception, match="blank:source_id"):
        lineage.strict(bad.withColumn("violations", lineage.violations(bad, {}, ["source_id", "record_id"]))).collect()


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"text {i % 3} a@b.co", f"2024-01-01 00:0{i}:00") for i in range(6)]
    batch = spark.createDataFrame(rows, "id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    a = run(variants.index_stream(stream, "id", "text"), "s1", "append")
    assert {tuple(r) for r in a.select("id", "canonical_sha256").collect()} == {tuple(r) for r in variants.index_stream(batch, "id", "text").select("id", "canonical_sha256").collect()}
    assert run(variants.first_copies(stream, "id", "text", "at", "1 hour"), "s2", "append").count() == 3
    assert run(variants.secret_counts(stream, "text", "at"), "s3", "update").agg(F.sum("findings")).first()[0] == 6
