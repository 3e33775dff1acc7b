"""Near duplicates and nearest neighbours, where copies and crowds are."""

import random

import pytest

import __spark_entry__ as entry
from siltstone.operators import contamination as N
from siltstone.operators import dedup as D


def test_copies_have_the_similarity_of_their_set(spark):
    s = [f"s{i}" for i in range(20)]
    sets = {1: s, 2: s[:18], 3: s[:18], 4: s, 5: s[1:], 6: ["x", "y"]}
    d = spark.createDataFrame(list(sets.items()), "key long, s array<string>")
    p = D.similar_pairs(d, "key", "s", 0.75)
    got = {r.key: (r.representative, r.similarity) for r in D.near_decisions(d.select("key"), D.near_clusters(p, 0.75), p, 0.75).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.9), 3: (1, 0.9), 4: (1, 1.0), 5: (1, 0.95)}


def test_nearest_is_found_behind_a_crowd(spark):
    w = [f"w{i}" for i in range(20)]
    crowd = [(i, " ".join(w[:5] + [f"d{i}_{j}" for j in range(5)])) for i in range(3001)]
    docs = spark.createDataFrame([*crowd, (9000, " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w)), (2, "none of these words are in any text")], "item_id long, text string")
    got = {r.item_id: (r.nearest, r.jaccard) for r in N.nearest(items, docs, "item_id", "doc_id", "text").collect()}
    assert got == {1: (9000, 1.0), 2: (None, 0.0)}


def test_clusters_match_brute_force_where_hashes_are_crowded(spark, monkeypatch):
    monkeypatch.setattr(D, "CROWD", 2)
    r = random.Random(5)
    sets = {}
    for i in range(80):
        b = [f"w{r.randrange(90)}" for _ in range(r.randint(1, 20))] if i < 15 else list(sets[r.randrange(i)])
        sets[i] = list(dict.fromkeys(b[r.randint(0, 1):] + [f"w{r.randrange(90)}" for _ in range(r.randint(0, 2))] + ["c1", "c2"][: r.randint(0, 2)])) or ["w"]
    like = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a in sets for b in sets if a < b}
    root = {k: k for k in sets}
    for _ in sets:
        for (a, b), j in like.items():
            if j >= 0.75:
                root[a] = root[b] = min(root[a], root[b])
    roots, pairs = D.similar_roots(spark.createDataFrame(list(sets.items()), "k long, s array<string>"), "k", "s", 0.75)
    assert {x.node: x.root for x in roots.collect()} == {k: v for k, v in root.items() if k != v}
    assert all(like[x.a, x.b] == x.jaccard for x in pairs.collect())


def test_near_copies_make_no_square_of_pairs(spark, monkeypatch):
    made, measured = [], D.measured
    monkeypatch.setattr(D, "measured", lambda c, g: made.append(c.count()) or measured(c, g))
    s = [f"s{i}" for i in range(40)]
    d = spark.createDataFrame([(i, s + [f"own{i}"]) for i in range(120)], "k long, s array<string>")
    roots, _ = D.similar_roots(d, "k", "s", 0.75)
    assert roots.count() == 119 and sum(made) < 4 * 120


@pytest.mark.parametrize("name,most", [("near_clusters", 0), ("near_decisions", 0), ("merged_decisions", 2), ("threshold_sweep", 0), ("lsh_pairs", 0)])
def test_texts_are_not_read_again_for_each_join(spark, name, most):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StringTrim") + plan.count("trim(") <= most
