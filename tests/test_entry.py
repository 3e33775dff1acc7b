"""The driver contract, and a sample of queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["exact_dups", "stable_bucket", "orders_temporal_split", "stratified_quota", "ngram_coverage_8", "length_profile", "cvss_base_score", "label_buckets", "holm_adjust", "lineage_violations", "near_clusters", "threshold_sweep", "replay_reasons", "two_source_table", "vector_fields", "manifest_problems"])
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, df.select(*cols).collect()))
    r = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    from pyspark.sql import Row

    want = sorted(str(Row(*cols)(*(row[i] for i in at))) for row in r.fetchall())
    assert got == want
