"""Golden values of scalar functions, and operators that SQL doesn't check."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as T
from siltstone.operators import contamination, dedup, entities, graph, lengths, pii, scoring, stats, trace


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_canonical(spark):
    raw = "A b \r\n c\t\t d \x07​  \n\n\n\n e f  ­ "
    df = T.canonical(spark.createDataFrame([(raw,), ("é",), (None,), ("plain",)], "text string"))
    rows = df.collect()
    assert rows[0].canonical == "A b\n c d\n\n ef"
    assert rows[1].canonical == "é" and rows[1].transforms == ["nfc"]
    assert rows[2].canonical == "" and rows[3].transforms == []


def test_stable_int(spark):
    assert one(spark, H.stable_int(F.col("s"), 1 << 62), s="a") == 763220579562798538
    assert one(spark, H.stable_int(F.col("s"), 3), s="a") == 1
    assert one(spark, H.stable_int(F.col("s"), 1 << 62), s="seed1") == 2278486388865609079


def test_minhash(spark):
    a, b = dedup.coefficients()
    assert (int(a[0]), int(b[0])) == (1794328123696316346, 269438951231838751)
    df = spark.createDataFrame([("a b c d e f g h i j",)], "t string").select(T.shingles(T.words(F.col("t"))).alias("s"))
    hashed = df.select(dedup.shingle_hashes(F.col("s")).alias("h"))
    row = hashed.withColumn("m", dedup.minhash(F.col("h"))).first()
    assert list(dedup.with_signature(hashed, "h").first().signature) == list(row.m)
    assert sorted(row.h) == [133586912, 452888022, 471464587, 1554994353, 1741687579, 3064173959]
    assert list(row.m[:6]) == [1188311482, 432259323, 426089322, 53678414, 78275013, 1248638596]
    assert dedup.bands_rows(0.72) == (16, 8)


@pytest.mark.parametrize("vector,score", [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
    ("CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:U/C:H/I:N/A:N", 4.7), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.0/AV:N", None), ("CVSS:3.1/AV:N/AC:L", None),
])
def test_cvss(spark, vector, score):
    assert one(spark, scoring.cvss31(F.col("v")), v=vector) == score


def test_mcnemar():
    assert stats.mcnemar_p(26, 62) == pytest.approx(0.000190711732, rel=1e-6)
    assert stats.mcnemar_p(42, 30) == pytest.approx(0.194850648609, rel=1e-6)
    assert stats.mcnemar_p(3, 9) == 0.14599609375
    assert stats.mcnemar_p(12, 12) == stats.mcnemar_p(0, 0) == 1.0


def test_boot_ci(spark):
    flags = [1, 0, 1, 1, 0, 1, 0, 1, 1, 1]
    assert stats.boot_ci(flags) == pytest.approx((0.4, 1.0))
    df = spark.createDataFrame([("g", i, bool(f)) for i, f in enumerate(flags)][::-1], "g string, k int, f boolean")
    r = stats.with_ci(df, ["g"], "k", "f").first()
    assert (r.n, r.k, r.lo, r.hi) == (10, 7, pytest.approx(0.4), pytest.approx(1.0))


def test_holm_and_mdd(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in zip("dacb", (0.005, 0.01, 0.03, 0.04))], "f string, k string, p double")
    got = {r.k: r.adjusted for r in stats.holm(df, ["f"], "p", "k").collect()}
    assert got == pytest.approx({"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06})
    assert one(spark, stats.mdd(F.col("p"), F.col("n")), p=0.39, n=3867) == pytest.approx(0.0310762760, rel=1e-8)


@pytest.mark.parametrize("sizes,bins,cut,padding", [([3000, 2000, 1000, 5000, 96, 4000], 4, 1, 0.1338), ([4096, 1], 2, 0, 0.4999)])
def test_greedy_pack(spark, sizes, bins, cut, padding):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "g string, i int, n int")
    r = lengths.greedy_pack(df, ["g"], "i", "n").first()
    assert (r.sequences, r.truncated) == (bins, cut) and r.padding == pytest.approx(padding, abs=5e-5)


@pytest.mark.parametrize("values,want", [([1, 2, 3, 4], (2, 3, 3)), ([1, 2, 3, 4, 5, 6], (2, 3, 5))])
def test_nearest_rank(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = contamination.nearest_rank(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (r.a, r.b, r.c) == want


def test_redaction_is_stable(spark):
    df = spark.createDataFrame([("mail a@b.co and a@b.co or c@d.org, 10.0.0.1, 8.8.8.8, token = \"abcdefgh1\"",), (None,), ("none",)], "t string")
    a, b, c = [r.x for r in df.select(pii.redact(F.col("t")).alias("x")).collect()]
    names = [w.strip(",") for w in a.split() if w.startswith("USER_")]
    assert names[0] == names[1] != names[2] and "IP_" in a and "8.8.8.8" in a and pii.MARKER in a and "@" not in a
    assert b is None and c == "none"


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100, 103: 100}


def test_similar_pairs_match_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    sets = {1: base, 2: base[:38] + ["x", "y"], 3: base, 4: base[:20], 5: ["q"], 6: []}
    df = spark.createDataFrame(list(sets.items()), "k long, s array<string>")
    got = {(r.a, r.b): r.jaccard for r in dedup.similar_pairs(df, "k", "s", 0.75).collect()}
    assert got == {(1, 2): pytest.approx(38 / 42), (1, 3): 1.0}


def test_matched_controls(spark):
    cases = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 3, 5)], "g string, k long, s long")
    controls = spark.createDataFrame([("a", 10, 12), ("a", 11, 9), ("a", 12, 9)], "g string, k long, s long")
    got = {(r.case_key, r.control_key) for r in stats.matched_controls(cases, controls, ["g"], "k", "s").collect()}
    assert got == {(1, 11), (2, 10)}


def test_longest_repeat_and_shape(spark):
    assert one(spark, T.longest_repeat(F.col("t")), t="a b a b a b c") == 6
    assert one(spark, T.longest_repeat(F.col("t")), t="a b c") == 0
    assert one(spark, T.unfenced(F.col("t")), t="```json\n{\"a\": 1}\n``` tail") == '{"a": 1}'
    assert one(spark, T.unfenced(F.col("t")), t="```\nopen") == "```\nopen"
    assert one(spark, T.numbers(F.col("t")), t="has 1,234.5 and `9` and v2x <!-- 7 --> [a](b/8) https://x/6") == ["1,234.5"]


def test_label_precedence_and_rendering(spark):
    e = F.array().cast("array<string>")
    assert one(spark, entities.resolve_label(F.lit(None).cast("string"), e, e, F.lit(True))["bucket"], x=1) == "rejected"
    assert one(spark, trace.rendered(F.col("x"), "pct"), x=0.123) == "12.3 %"
    assert one(spark, lengths.learning_rate(F.col("x"), 10, 110, 1.0), x=60) == pytest.approx(0.5)
    assert math.isclose(one(spark, trace.calculated("hours", F.col("x")), x=7200), 2.0)
