"""All similar pairs: copies, crowds and rounds leave none out."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from siltstone.operators import dedup as D
from siltstone.operators import similar as M


def likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def family(r, n):
    """Sets derived from each other, with copies and two common members."""
    sets = {}
    for i in range(n):
        b = [f"w{r.randrange(90)}" for _ in range(r.randint(1, 40))] if i < n // 5 else list(sets[r.randrange(i)])
        if r.random() < 0.7:
            b = b[r.randint(0, 1):] + [f"w{r.randrange(90)}" for _ in range(r.randint(0, 2))] + ["c1", "c2"][: r.randint(0, 2)]
        sets[i] = list(dict.fromkeys(b)) or ["w"]
        r.shuffle(sets[i])
    return sets


@pytest.mark.parametrize("threshold,small", [(0.6, {}), (0.6, {"CROWD": 2, "SHARE": 1, "ROUND_BYTES": 400, "BLOCK": 2, "GROUP": 5, "KEYS": 7, "ROWS": 3, "PAIRS": 5}), (0.75, {"CROWD": 5, "SHARE": 2, "DEPTH": 3})])
def test_copies_have_pairs_with_all_similar_sets(spark, monkeypatch, threshold, small):
    for name, value in small.items():
        monkeypatch.setattr(M, name, value)
    sets = family(random.Random(11), 90)
    want = {(a, b): likeness(sets[a], sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in want.items() if j >= threshold}
    d = spark.createDataFrame([*sets.items(), (None, sets[0]), (900, []), (901, None)], "k long, s array<string>")
    got = [(r.a, r.b, r.jaccard) for r in D.all_pairs(d, "k", "s", threshold).collect()]
    assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    assert any(sets[a] != sets[b] and any(set(sets[x]) == set(sets[b]) for x in sets if x < b) for a, b in want)  # a copy's pair

    members, pairs = M.similar(d, "k", "s", threshold)
    size = {k: None if k % 10 == 0 else 10 * len(s) + k % 3 for k, s in sets.items()}
    got = Counter()
    for r in M.weighed(members, pairs, spark.createDataFrame(list(size.items()), "k long, x long"), 10).where("label is not null").collect():
        got[r.jaccard, r.label] += r.pairs
    assert got == Counter((j, int(abs(size[a] - size[b]) <= 10)) for (a, b), j in want.items() if size[a] is not None and size[b] is not None)


def test_string_keys_and_no_pairs(spark):
    d = spark.createDataFrame([("x", [1, 2, 3, 4]), ("y", [4, 3, 2, 1]), ("z", [9])], "k string, s array<long>")
    assert [tuple(r) for r in D.all_pairs(d, "k", "s", 0.6).collect()] == [("x", "y", 1.0)]
    assert D.all_pairs(d.where("k = 'z'"), "k", "s", 0.6).count() == 0
    assert D.all_pairs(d.where("k = 'none'"), "k", "s", 0.6).count() == 0


def test_moved_sets_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch):
    counted = {}
    monkeypatch.setattr(M, "erase", lambda *t: [counted.__setitem__(tuple(x.columns), x.count()) for x in t])
    s = [f"s{i}" for i in range(40)]
    members, pairs = M.similar(spark.createDataFrame([(i, s + [f"own{i}"]) for i in range(120)], "k long, s array<string>"), "k", "s", 0.6)
    assert pairs.count() == 120 * 119 // 2 and counted[("w", "k")] <= 3 * 120


def documents(tmp_path, spark, texts):
    rows = [(i, t, c, "src", len(t)) for i, (t, c) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_sweep_counts_the_pairs_of_copies(spark, tmp_path):
    w = [f"word{i}" for i in range(60)]
    texts = [(" ".join(w), "en")] * 3 + [(" ".join(w[:50]), "en")] * 2 + [(" ".join(w), None)] * 3 + [(" ".join(w), "de")]
    d = documents(tmp_path, spark, texts)
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in entry.queries()["threshold_sweep"](spark, d).collect()}
    # copies: 3 pairs of three, 1 of two, 3 without language; 6 pairs of similarity 46 / 56 whose lengths differ by more than 20
    assert got == {0.6: (7, 6, 0), 0.7: (7, 6, 0), 0.75: (7, 6, 0), 0.8: (7, 6, 0), 0.9: (7, 0, 0)}
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert {r[0]: tuple(r[1:4]) for r in c.sql(entry.oracle_sql()["threshold_sweep"]).fetchall()} == got


def test_crowded_buckets_give_all_pairs(spark, tmp_path):
    n = 310
    w = [f"word{i}" for i in range(120)]
    near = [(" ".join([*w[:119], f"end{i}"]), "en") for i in range(n)]
    d = documents(tmp_path, spark, near + [(" ".join(w), "de")] * n + [(" ".join(w), None)] * 3)
    got = [(r.a, r.b, r.jaccard) for r in entry.queries()["lsh_pairs"](spark, d).collect()]
    assert len(got) == len({x[:2] for x in got}) == n * (n - 1)
    assert all(a < b and (j == pytest.approx(115 / 117) if b < n else a >= n and b < 2 * n and j == 1) for a, b, j in got)
