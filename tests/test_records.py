"""Record building, guards and the fixes of scoring and text functions."""

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import pii, records, scoring


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col.alias("x")).collect()]


def test_repeated_metric_takes_its_last_value(spark):
    v = ["CVSS:3.1/AV:P/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H/AV:N", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N", None]
    assert one(spark, [(x,) for x in v], "v string", scoring.cvss31(F.col("v"))) == [9.8, 9.8, None, None]


def test_text_functions(spark):
    assert one(spark, [("",), ("ab",), ("a\x00",)], "t string", T.bad_char_ratio(F.col("t"))) == [1.0, 0.0, 0.5]
    assert one(spark, [("2.v3 and 7",)], "t string", T.numbers(F.col("t"))) == [["2", "3", "7"]]
    assert one(spark, [("é",), ("plain",), (None,)], "t string", T.nfc(F.col("t"))) == ["é", "plain", None]


def test_gated_patterns_find_the_same(spark):
    texts = [("mail a@b.co and 10.0.0.1 host.corp", 1), ("AKIA" + "A" * 16, 2), ("ghp_" + "a" * 36, 3), ("postgres://u:p@h -----BEGIN RSA PRIVATE KEY-----", 4), (None, 5), ("eyJabcdefgh.abcdefgh.abcdefgh xoxb-1234567890", 6)]
    df = spark.createDataFrame(texts, "text string, id int")
    got = sorted((r.id, r.type, r.value) for r in pii.findings(df, ["id"]).collect())
    whole = [df.select("id", F.lit(t).alias("type"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), F.lit(0))).alias("value")) for t, _, p in pii.TYPES]
    assert got == sorted((r.id, r.type, r.value) for d in whole for r in d.collect()) and len(got) >= 8


def test_records(spark):
    lead, rest = [F.col("a"), F.col("b")], [F.col("c")]
    assert one(spark, [("x", None, "z"), ("", "y", "z"), (None, "", "z"), (None, None, None)], "a string, b string, c string", records.text_of(lead, rest)) == ["x", "y", "z", ""]
    rules = [("p", F.col("a") > 1), ("q", F.col("a") > 0)]
    assert one(spark, [(2,), (1,), (0,), (None,)], "a int", records.first_reason(rules)) == ["p", "q", None, None]
    assert one(spark, [(["a", "b", "c", "d"], 3), (["a", "b", "c", "d"], 4), (["a"], 0), (None, 0)], "c array<string>, g int", records.choice(F.col("c"), F.col("g"))) == ["d", None, None, None]
    main = spark.createDataFrame([(1, "A", None), (2, None, "2020")], "k int, state string, date string")
    other = spark.createDataFrame([(1, "2019"), (3, "2021")], "k int, date string")
    made = spark.createDataFrame([(1, False, "near"), (3, False, "near")], "k int, keep boolean, stage string")
    assert sorted(map(tuple, records.two_sources(main, other, made, "k").collect())) == [(1, "A", "2019", False, "near"), (2, None, "2020", True, "none"), (3, None, "2021", True, "none")]
    m = spark.createDataFrame([(1, "Secondary", 1, "x"), (1, "Primary", 2, "y"), (2, "Secondary", 2, "b"), (2, "Secondary", 1, "a")], "k int, kind string, o int, v string")
    assert sorted(map(tuple, records.primary_metric(m, "k", "kind", "o", ["v"]).collect())) == [(1, "Primary", "y"), (2, "Secondary", "a")]
    d = "a" * 64
    rows = [("dir", d, d), ("dir", None, d), ("file", None, d), ("file", "A" * 64, d), ("file", "b" * 64, d), ("file", d, d)]
    assert one(spark, rows, "k string, d string, f string", records.digest_problem(F.col("k"), F.col("d"), F.col("f"))) == ["directory_with_digest", None, "no_digest", "malformed_digest", "other_bytes", None]
