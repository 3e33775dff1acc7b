"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, common, decontamination, hnsw, licenses, packing, partenum, rollups, sstable, suffixes, toxicity, urls
from siltstone.llm.wordscan import ALNUM, SPACED, Words, shingles, word_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ñu", "The", "AND"]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 30, 80, 150])))
        if i % 7 == 3 and rows:  # a near copy
            w = (r.choice(rows)[1] or "").split()
            t = " ".join(r.choice(vocab) if r.random() < 0.03 else x for x in w)
        if i % 11 == 5:
            t = t[: len(t) // 2] + " " + passage + t[len(t) // 2 :]
        rows.append((i, t, "en", "hot" if i % 3 == 0 else f"s{i % 5}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "x", 0), (n + 2, rows[4][1], "de", "x", 1), (n + 3, "z" * 3000, "en", "x", 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def empty(spark, extra=""):
    return spark.createDataFrame([], DOCS + extra)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


ODD = ["I'll  don't 's've x'd\n\n  y' s  '' 're", "", " ", "a\t\tb  \n", "it's 12ab3 ½ é'll l'l", "'", "<|endoftext|> hi", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n\n<|endoftext", "<|endoftext|>", "日本語 テキスト'd 😀 !!", " 're're 'r", "x\x00y \x1c z", "'s 'v 'llm"]


def test_memo_tokenizer_equals_library(tok):
    texts = ODD + [r[1] or "" for r in corpus()]
    m = bpe.MemoTokenizer(bpe.default_path())
    for _ in range(2):
        ids, off = m.encode(texts)
        assert [list(ids[a:b]) for a, b in zip(off, off[1:])] == [tok(t) for t in texts]
    small = bpe.MemoTokenizer(bpe.default_path())
    small.BITS = 5
    small._clear()
    ids, off = small.encode(texts[:20])
    assert [list(ids[a:b]) for a, b in zip(off, off[1:])] == [tok(t) for t in texts[:20]]


def test_words_and_shingles():
    texts = ["Ab c-D é9", "", "one two", "a b c d e f A B C D E"]
    buf, off = common.flat(pa.array(texts))
    w = Words(buf, off, ALNUM)
    assert [w.text(i).decode() for i in range(len(w))] == [x for t in texts for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))]
    assert int(w.hash[0]) == word_hash(b"ab")
    h, o = shingles(Words(buf, off, SPACED), 5)
    assert np.diff(o).tolist() == [1, 0, 1, 6]


def brute_leaks(texts, items):
    out = {}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for d, t in texts.items():
        for i, u in items.items():
            a, b = words(t), words(u)
            found = False
            for diagonal in range(-len(b), len(a)):
                lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
                if hi <= lo:
                    continue
                agree = np.array([a[diagonal + j] == b[j] for j in range(lo, hi)])
                x, y = decontamination.best_overlap(agree)
                found |= y - x >= min(decontamination.MIN_SPAN, len(b)) and agree[x:y].sum() >= decontamination.MIN_IDENTITY * (y - x)
            if found and b:
                out[d, i] = True
    return set(out)


def test_decontamination(spark):
    r = random.Random(1)
    v = [f"v{i}" for i in range(400)]
    item = [r.choice(v) for _ in range(40)]
    swapped = [("zz" if i % 9 == 4 else x) for i, x in enumerate(item)]
    text = lambda w: " ".join(w)
    pad = lambda: [r.choice(v) for _ in range(50)]
    texts = {1: text(pad() + item + pad()), 2: text(pad() + swapped + pad()).upper(), 3: text(pad()), 4: None, 5: "", 6: text(pad() + item[10:26]), 7: "short item here", 8: text(item[:6])}
    items = {1: text(item), 2: "Short ITEM", 3: None, 4: ""}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert got == brute_leaks(texts, items) == {(1, 1), (2, 1), (6, 1), (7, 2)}
    assert got == {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench, block_words=1).collect()}
    assert {x.doc_id for x in decontamination.keep_clean(docs, bench).collect()} == {3, 4, 5, 8}
    none = bench.limit(0)
    assert decontamination.leaks(docs, none).count() == 0 and decontamination.keep_clean(docs, none).count() == len(texts)
    assert decontamination.leaks(docs.limit(0), bench).count() == 0


def stretch_passes(a, b):
    """Whether any stretch of 13 words of b (or all of them) has 75 % at its places in a."""
    least = min(13, len(b))
    for diagonal in range(-len(b), len(a)):
        lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
        same = [0]
        for j in range(lo, hi):
            same.append(same[-1] + (a[diagonal + j] == b[j]))
        for x in range(hi - lo):
            for y in range(x + least, hi - lo + 1):
                if 4 * (same[y] - same[x]) >= 3 * (y - x):
                    return True
    return False


def test_decontamination_finds_every_stretch():
    r = random.Random(8)
    v = [f"v{i}" for i in range(3000)]
    items = [[r.choice(v) for _ in range(n)] for n in [*range(1, 13), *range(13, 30), 40, 40]]
    texts = [["v1"] * 3 + items[13][:12] + ["no"] + items[13][13:14], items[11][:9] + ["no"] * 3]
    for k in range(400):
        item = items[k % len(items)]
        a = r.randint(0, max(0, len(item) - 13))
        part = item[a : a + max(13, r.choice([13, 14, 15, 16, 20, 24, 40]))]
        gone = set(r.sample(range(len(part)), min(len(part), len(part) // 4 + r.choice([0, 0, 0, 1]))))
        texts.append([r.choice(v) for _ in range(r.randint(0, 5))] + ["no" if i in gone else w for i, w in enumerate(part)] + [r.choice(v) for _ in range(r.randint(0, 5))])
    seeds = decontamination.Seeds(list(range(len(items))), [" ".join(x) for x in items])
    words = Words(*common.flat(pa.array([" ".join(t) for t in texts])), ALNUM)
    found = list(seeds.find(words))
    got = {(d, i) for d, i, g in found if decontamination.verified(words, seeds, d, i, g)}
    assert len(found) == len(set(found)) and got == {(d, i) for d, i, _ in found}
    assert got == {(d, i) for d, t in enumerate(texts) for i, u in enumerate(items) if stretch_passes(t, u)}


def test_masks_are_lossless():
    from itertools import combinations

    def met(masks, n):
        placed = [sum(1 << i + s for i, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)]
        for lost in combinations(range(n), n // 4):
            kept = (1 << n) - 1 - sum(1 << i for i in lost)
            assert any(kept & p == p for p in placed), (n, lost)

    for n, masks in decontamination.SHORT_MASKS.items():
        met(masks, n)
    for n in range(13, 26):
        met(decontamination.MASKS, n)


def test_licenses(spark):
    t = licenses.Template("x", "a [b|c d] <<2>> e")
    ok = lambda s: t.match(s.split()) == len(s.split())
    assert ok("a e") and ok("a b e") and ok("a c d e") and ok("a q e") and ok("a b q r e")
    assert not ok("a c e f e e e") and t.match("a d d d e".split()) == -1 and t.match(["b", "e"]) == -1
    texts = {1: "Released under the MIT License.", 2: "x Licensed under the Apache License, Version 2.0. under the mit license", 3: "Licensed under CC BY-NC 4.0.", 4: None, 5: "", 6: "under the MIT", 7: "This work is licensed under the GNU General Public License, version 3.", 8: "mit license under the"}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, v, 1.0) for k, v in texts.items()], "doc_id long, text string, score double")).collect()}
    assert (got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("mit", 1, 1, 1)
    assert (got[2].base_labels, got[2].labels, got[2].n_base, got[2].first_word, got[2].last_word) == ("apache-2,mit", "apache-2,mit", 2, 4, 9)
    assert (got[3].base_labels, got[3].labels) == ("cc-by-nc", "cc-by-nc")
    assert got[7].base_labels == "" and got[7].labels == "gpl-3" and got[7].score > 0.5
    for k in (4, 5, 6, 8):
        assert (got[k].base_labels, got[k].labels, got[k].first_word, got[k].score) == ("", "", None, 0.0)


def test_license_places_match_brute_force(spark):
    r = random.Random(5)
    v = "under the mit license apache version 2 cc by nc x".split()
    texts = {i: " ".join(r.choice(v) for _ in range(200)) for i in range(30)}
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        w = t.split()
        at = [j for _, p in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (got[i].n_base, got[i].first_word, got[i].last_word, got[i].n_words) == (len(at), min(at, default=None), max(at, default=None), 200)


def test_rollups(spark):
    r = rollups.Rollup(spark)
    rows = [("s", "en", 1, 10), ("s", "en", 2, 5), (None, "de", 3, 7), ("s", "en", 1, 10)]
    df = spark.createDataFrame(rows, "source string, lang string, id long, tokens long")
    from pyspark.sql import functions as F

    v = lambda n, add=0: F.struct(F.lit(n).alias("tokenizer"), (F.col("tokens") + add).alias("tokens"))
    totals = lambda: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert totals() == {}
    assert r.commit("a", rollups.changes(df, "insert", after=v("t1")))
    assert totals() == {("s", "en", "t1"): (3, 25), (None, "de", "t1"): (1, 7)}
    assert not r.commit("a", rollups.changes(df, "insert", after=v("t1")))
    assert r.commit("b", rollups.changes(df.where("lang = 'de'"), "revise", before=v("t1"), after=v("t2", 3)))
    want = {("s", "en", "t1"): (3, 25), (None, "de", "t2"): (1, 10)}
    assert totals() == want
    r.compact()
    assert totals() == want and not r.commit("b", rollups.changes(df, "insert", after=v("t1"))) and totals() == want
    assert r.commit("c", rollups.changes(df.where("id = 1"), "delete", before=v("t1")))
    assert totals() == {("s", "en", "t1"): (1, 5), (None, "de", "t2"): (1, 10)}
    assert r.commit("d", rollups.changes(df.limit(0), "delete", before=v("t1")))


def test_rollups_compact_many_batches(spark):
    from pyspark.sql import functions as F

    r = rollups.Rollup(spark)
    v = F.struct(F.lit(None).cast("string").alias("tokenizer"), F.col("tokens"))
    df = spark.createDataFrame([(None, "en", 3, 1, 2), ("s", None, None, 1, 2)], "source string, lang string, tokens long, docs long, sign long")
    names = [f"2026-11-26-hour-{i:02}-crawl-part-of-a-long-name" for i in range(14)]
    for n in names[:12]:
        assert r.commit(n, rollups.changes(df, "insert", after=v))
    r.compact()
    fs, top = r._fs(), r._path("commits")
    first = [s.getPath() for s in fs.listStatus(top)]
    assert len(first) == 1 and set(r.batches()) == set(names[:12])
    assert r.commit(names[12], rollups.changes(df, "insert", after=v)) and not r.commit(names[3], rollups.changes(df, "insert", after=v))
    r.compact()
    fs.create(first[0], False).close()  # as if the crash came before the first list's marker went
    assert set(r.batches()) == set(names[:13]) and not r.commit(names[0], rollups.changes(df, "insert", after=v))
    assert {(x.source, x.lang, x.tokenizer, x.docs, x.tokens) for x in r.totals().collect()} == {(None, "en", None, 13, 39), ("s", None, None, 13, 0)}
    assert rollups.counted(empty(spark, ", tokens long, empty int")).count() == 0
    with pytest.raises(ValueError):
        r.commit("many", df)


def test_rollup_query_matches_counts(spark, tok):
    sf = "/root/testdata/sf0.001"
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.text:
            want[r.source, r.lang] += len(tok(r.text)) + 1
    assert {(r.source, r.lang): r.tokens for r in rollups.op3_token_rollup(spark, sf).collect()} == dict(want)


def test_differencing_balances():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 320, 400)
    window, load = packing.differencing(sizes, 40)
    assert load.sum() == sizes.sum() and (np.bincount(window, sizes, 40) == load).all() and load.max() - load.min() < 60
    window, k = packing.windows(sizes, 1024)
    assert np.bincount(window, sizes).max() <= 1024 and k <= -(-sizes.sum() // 1024) * 1.05 + 1
    assert packing.windows(np.zeros(0, int), 8)[1] == 0


def check_pieces(rows, texts, tok, cap=1024):
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = np.array([*tok(t), 0], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(seq)


def test_packing(spark, docs, tok):
    texts = {r[0]: r[1] for r in corpus()}
    rows = packing.pack(docs).collect()
    n = check_pieces(rows, texts, tok)
    total = sum(r.length for r in rows)
    assert n * 1024 - total < 3 * 1024 + 0.05 * total  # three tasks, a last window each
    assert packing.pack(empty(spark)).count() == 0
    ids = packing.pack(docs.limit(5), with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in ids)


def test_sstable(spark, docs, tok):
    texts = {r[0]: r[1] for r in corpus()}
    m = sstable.write_shards(docs, shard_bytes=2000)
    at, want = 0, []
    for d in sorted(texts):
        ids = np.array([*tok(texts[d]), 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in sstable.read_digests(m).collect()) == want
    assert list(sstable.lookup(m, 7)) == [*tok(texts[7]), 2] and sstable.lookup(m, 10**9) is None
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (-5, "m")], "doc_id long, text string")
    assert sorted((r.start, r.doc_id) for r in sstable.read_digests(sstable.write_shards(twice)).collect()) == [(0, None), (2, -5), (4, 1), (6, 1)]
    assert sstable.read_digests(sstable.write_shards(empty(spark))).count() == 0


def test_shard_file(tmp_path):
    p = str(tmp_path / "x.sst")
    with sstable.opened(p, "w") as f:
        w = sstable.Writer(f)
        for i in range(0, 5000, 2):
            w.add(sstable.key_of(i), sstable.value_of(np.arange(i % 50) + 65500))
        w.close()
    with sstable.opened(p, "r") as f:
        r = sstable.Reader(f)
        assert len(list(r)) == 2500 and r.get(sstable.key_of(77)) is None
        assert list(sstable.ids_of(r.get(sstable.key_of(4048)))) == list(range(65500, 65548))
        assert sum(r.may_hold(sstable.key_of(i)) for i in range(1, 5000, 2)) < 250


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in sets}


@pytest.mark.parametrize("crowd,local", [(partenum.CROWD, partenum.LOCAL), (3, 2)])
def test_jaccard_join(spark, monkeypatch, crowd, local):
    monkeypatch.setattr(partenum, "CROWD", crowd)
    monkeypatch.setattr(partenum, "LOCAL", local)
    r = random.Random(7)
    v = [f"q{i}" for i in range(500)]
    base = [r.choice(v) for _ in range(60)]
    texts = {r_[0]: r_[1] for r_ in corpus(60)}
    for i in range(1000, 1030):  # a family of near copies around the threshold
        texts[i] = " ".join(r.choice(v) if r.random() < r.choice([0.01, 0.03, 0.05]) else x for x in base)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.join(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_join_odd_tables(spark):
    assert partenum.join(empty(spark, ", key long, kind int, n long")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (3, "A B c d e f")], "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in partenum.join(df).collect()) == Counter([(1, 1), (1, 1), (None, None), (3, 1)])
    assert sorted((r.doc_id or 0) for r in partenum.keep_first(df).collect()) == [0, 1]


def test_jaccard_join_of_crowds(spark, monkeypatch):
    """Texts of a common passage with more or less of their own: crowded groups, few links."""
    r = random.Random(17)
    v = [f"c{i}" for i in range(2000)]
    base = [r.choice(v) for _ in range(80)]
    texts = {i: " ".join(base[: 80 - i % 30] + [r.choice(v) for _ in range(i % 50)]) for i in range(400)}
    texts |= {i: " ".join(r.choice(v) if r.random() < 0.04 else x for x in base) for i in range(400, 500)}
    seen = []
    whole = partenum._crowds
    monkeypatch.setattr(partenum, "_crowds", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(partenum, "BLOCK", 64)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.join(df).collect()} == brute_components(texts)
    assert seen  # the exact way for crowds ran


def test_keep_first_decides_by_row(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(1, a, 5), (1, b, 6), (2, a, 7), (2, "", 8), (None, b, 9), (None, None, 10), (None, "m n o", 11), (None, "m n o", 11), (3, " \t", 12), (3, " \t", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = partenum.keep_first(df)
    assert got.columns == df.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, a, 5), (1, b, 6), (2, "", 8), (None, None, 10), (None, "m n o", 11), (3, " \t", 12), (3, " \t", 12)])
    assert partenum.keep_first(df.limit(0)).count() == 0


def test_packed_signatures():
    r = np.random.default_rng(4)
    for n, top in ((1, 5), (3, 1 << 33), (5000, 1 << 40), (70000, 1 << 36)):
        s = np.sort(r.integers(0, top, n).astype(np.uint64))
        idx, hot = r.integers(0, min(n, 4000), n), r.integers(0, 2, n)
        keys = r.integers(-(1 << 62), 1 << 62, 4000)
        x, y, z = partenum.unpack(partenum.pack(s, idx << 1 | hot, keys))
        assert (x == s).all() and (y == keys[idx]).all() and (z == hot.astype(bool)).all()


def test_signatures_find_every_similar_pair():
    r = np.random.default_rng(2)
    for size in (1, 4, 9, 40, 200, 1500):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
            drop = int(r.integers(0, len(a) // 7 + 1))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[drop:]], r.integers(0, 1 << 63, drop, dtype=np.uint64) << np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both) and both:
                s, o, _ = partenum.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(s[o == 0]) & set(s[o == 1])
                assert partenum.may_link(partenum.sketch(a), partenum.sketch(b), len(a), len(b))


def test_signatures_leave_out_the_surplus_and_keep_slack():
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
    sets = [np.unique(fresh(n)) for n in r.integers(100, 1000, 200)]
    s, _, _ = partenum.signatures(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]))
    assert len(s) < 1.7 * sum(map(len, sets))
    for a in sets[:60]:  # partners of all sizes, in the own band and in lower ones
        b = a[np.sort(r.permutation(len(a))[: int(r.integers(-(-3 * len(a) // 4), len(a) + 1))])]
        off = np.array([0, len(a), len(a) + len(b)])
        s, o, slack = partenum.signatures(np.concatenate([a, b]), off)
        assert len(set(s[o == 0].tolist()) & set(s[o == 1].tolist())) >= 1 + slack.max()
        low, high = (partenum.signatures(np.concatenate([a, b]), off, partenum.SIG_BITS, *x) for x in ((0, 1 << 39), (1 << 39,)))
        assert sorted(zip(s, o)) == sorted([*zip(*low[:2]), *zip(*high[:2])]) and (low[2] == slack).all()


def test_signatures_of_a_bucket_stay_as_long():
    for buckets in (64, 85, 5000, partenum.MOST_BUCKETS):
        assert (1 << partenum.sig_bits(buckets)) // buckets >= 1 << 33 and partenum.sig_bits(buckets) <= 52


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("block", [16, 4096])
def test_crowds_of_the_same_sets_are_sent_once(spark, monkeypatch, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    r = random.Random(5)
    texts, crowds = [], set()
    for g in range(4):
        base = [f"g{g}w{r.randrange(10**6)}" for _ in range(300)]
        kin = [base if i % 2 else base[:150] + [f"x{r.randrange(10**6)}" for _ in range(110 + 40 * (i % 3))] for i in range(40)]
        for i, w in enumerate(kin):
            w = list(w)
            for _ in range(i % 9):
                w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
            texts.append((40 * g + i, " ".join(w)))
        for f in range(50):  # one feature of the group after the other, which a few of the sets don't have
            crowds |= {(1000 * g + f, 40 * g + i) for i in range(40) if r.random() < 0.95}
    crowds |= {(9000, i) for i in range(0, 160, 3)}  # and one across the groups
    keys, docs = spark.createDataFrame(sorted(crowds), "crowd long, key long"), spark.createDataFrame(texts, "key long, text string")
    comp = spark.createDataFrame([(3, 1)], "node long, root long")
    before = shuffled(spark)
    got = partenum._crowds(keys, comp, docs).collect()
    sent = shuffled(spark) - before
    roots = {x.node: x.root for x in common.components(spark.createDataFrame([(3, 1), *((x.a, x.b) for x in got)], "a long, b long")).collect()}
    assert {i: roots.get(i, i) for i, _ in texts} == {i: c for i, (_, c) in brute_components(dict(texts)).items()}
    assert 0 < sent < 3 * 8 * sum(len(t.split()) for _, t in texts) * (4 if block == 16 else 1)


@pytest.mark.parametrize("crowd,local", [(partenum.CROWD, partenum.LOCAL), (3, 2)])
def test_jaccard_join_in_rounds(spark, monkeypatch, crowd, local):
    monkeypatch.setattr(partenum, "CROWD", crowd)
    monkeypatch.setattr(partenum, "LOCAL", local)
    r = random.Random(8)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(i) for i in range(90)]
    texts = {i: " ".join(f"z{r.random()}" if r.random() < 0.02 else x for x in base[: r.randrange(60, 90)]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert partenum.rounds(9) == 2
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in partenum.join(df, 9).collect()} == brute_components(texts)


def test_swept_queries_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled() -> set:
        blocks = disk.getAllBlocks()
        return {n for i in range(blocks.size()) if (n := blocks.apply(i).toString()).startswith("shuffle_")}

    before = shuffled()
    out = partenum.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 7
    assert spark.conf.get(common.SWEEP, "false") == "false"


def test_urls(spark):
    rows = ["http://a.net/", "https://Sub.Example.NET/en/x?q", "http://notexample.net", "http://example.com/de/1", "http://example.com/DE/1", "http://x.org/fr/", "http://spam-farm.example.org/en/1", None, "", "no scheme/net/", "http://x.com/login?a", "http://www.cheap-pills.example.com/en/4", "http://x.net/spam-farm/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)] + [(0, rows[0], "h")], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()]
    assert Counter(got) == Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, most=0).collect())
    by = {g[0]: g[1:] for g in got}
    assert by[0] == ("a.net", "/", "net/", "block") and by[1] == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert by[2] == ("notexample.net", "", None, "allow") and by[3][2:] == ("example.com/de/", "block") and by[4][2:] == (None, "allow")
    assert by[5][2:] == ("org/fr/", "allow") and by[6][2:] == (None, "block") and by[7] == by[8] == ("", "", None, "allow") and by[9] == ("", "", None, "allow")
    assert by[10][3] == by[11][3] == by[12][3] == "block" and by[12][2] == "net/"
    assert urls.judge(df.limit(0)).count() == 0


def test_url_index_drops_no_branch(spark):
    hosts = ["spam-farm.com", "a.spam-farm.com", "a-spam-farm-b.com", "cheap-pills.com", "x.cheap-pills-y.com", "xxx.example.com", "a.xxx.example.com", "porn.example.com", "a.porn.com", "a.xxx", "a.xxx:80", "free-casino.com", "casino.com", "a-casino-b.com"]
    paths = ["cart", "cart?id=1", "cart/", "cart/#x", "checkout", "checkout/?a", "login", "login.php", "wp-login.php", "login?x", "wp-login", "?sessid=1", "?phpsessid=1", "a?b&sessid=2", "a;phpsessid=3", "carts", "logins", "cartx/checkouts"]
    rows = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1")] + [f"http://shop.example.com/{p}" for p in paths]
    want = {}
    for u in rows:
        fits = [r for r in urls.PATTERN_RULES if re.search(r.pattern, u)]
        best = max(fits, key=lambda r: (r.weight, r.name), default=None)
        want[u] = (best.name, best.verdict) if best else (None, "allow")
    hit = {r.name for u in rows for r in urls.PATTERN_RULES if re.search(r.pattern, u)}
    assert hit == {r.name for r in urls.PATTERN_RULES} and want["http://shop.example.com/cart"][1] == want["http://xxx.example.com/en/1"][1] == "block"
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    for most in (urls.BROADCAST_BYTES, 0):
        assert {r.url: (r.method_rule, r.verdict) for r in urls.judge(df, urls.PATTERN_RULES, most).collect()} == want
    for u in rows:  # every match holds all tokens of one of its rule's branches
        have = set(re.split("[^a-z0-9]+", u.lower()))
        for r in urls.PATTERN_RULES:
            assert not re.search(r.pattern, u) or any(set(b) <= have for b in urls.literals(r.pattern))


def test_url_rules_literals(spark):
    known = {
        r"/(?:cart|checkout)/?(?:[?#]|$)": {("cart",), ("checkout",)},
        r"[?&;](?:php)?sessid=": {("sessid",), ("phpsessid",)},
        r"ab/c[d-f]/x+y-zz$": {("zz",)},
        r"^a(b|c)*d": {()},
    }
    for pattern, want in known.items():
        assert urls.literals(pattern) == want
    r = random.Random(5)
    rules = [urls.Rule(f"rule-{i:04}", "block", rf"://(?:[^/?#]*\.)?(?:h{i}|g{i})\.(?:com|net)/|/p{i}(?:[/?]|$)") for i in range(400)]
    rules.append(urls.Rule("vague", "block", "zz[0-9]+q"))
    pages = [f"http://{r.choice(['h', 'g', 'x'])}{r.randrange(500)}.{r.choice(['com', 'net', 'org'])}/{r.choice(['a', f'p{r.randrange(500)}', 'zz12q'])}" for _ in range(150)] + [None]
    df = spark.createDataFrame([(None if i == 7 else i, u) for i, u in enumerate(pages)], "page_id long, url string")
    want = Counter((None if i == 7 else i, max((x.name for x in rules if re.search(x.pattern, u or "")), default=None, key=lambda n: (len(n), n))) for i, u in enumerate(pages))
    assert Counter((x.page_id, x.method_rule) for x in urls.judge(df, rules).collect()) == want


def test_embeddings(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 16))
    x[300:500] = x[0] + 0.05 * r.normal(size=(200, 16))
    x[500:600] = x[10:110]
    rows = [(i, [float(f) for f in np.float32(v)], i % 2) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0, None], 0), (2005, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df, shard=256).collect()}
    assert set(got) == {r[0] for r in rows}
    links = Counter()
    u = np.float32(x).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    for i in range(900):
        for j in np.flatnonzero(u[i] @ u.T >= 0.98):
            if j != i and (i - j) % 2 == 0:
                links[i] += 1
    assert sum(got[i].n_links for i in range(900)) >= 0.95 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in range(900))
    for i in range(2000, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def brute_vectors(rows, threshold=0.98):
    """{row number: (n_links, component_id, kept)} of (vec_id, unit vector, label)."""
    x = np.array([r[1] for r in rows])
    label = [r[2] for r in rows]
    hit = (x @ x.T >= threshold) & np.array([[a == b for b in label] for a in label])
    np.fill_diagonal(hit, False)
    low = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(low, np.where(hit, low[None, :], low.max()).min(1))
        for i in set(new.tolist()):  # rows of one identifier are one vertex
            same = [k for k, r in enumerate(rows) if r[0] == i]
            new[same] = new[same].min()
        if (new == low).all():
            break
        low = new
    return [(r[0], int(n), int(c), r[0] == c) for r, n, c in zip(rows, hit.sum(1), low)]


@pytest.mark.parametrize("shard", [256, 4096])
def test_embedding_components(spark, shard):
    """Chains, dense groups wider than a beam, equal vectors, a tie at the threshold, labels of text, clashing columns."""
    r = np.random.default_rng(8)
    x = r.normal(size=(700, 8))
    for i in range(300, 340):  # a chain: neighbours are linked, ends are not
        x[i] = hnsw.unit(x[i - 1 : i])[0] + 0.12 * hnsw.unit(r.normal(size=(1, 8)))[0]
    x[400:520] = x[5] + 0.1 * r.normal(size=(120, 8))
    x[600:610] = x[610:620]
    x[690], x[691] = 0, 0
    x[690, 0], x[691, :2] = 1.0, (0.98, np.sqrt(1 - 0.98**2))
    x[692:694], x[694:696] = x[690:692] * 1e200, x[690:692] * 1e-200
    rows = [(i, [float(f) for f in v], "ab"[i % 7 == 0]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*q, 1, 2) for q in rows], "vec_id long, embedding array<double>, label string, shard int, k int")
    want = brute_vectors([(i, hnsw.unit(np.array([v]))[0], lab) for i, v, lab in rows])
    got = [tuple(q) for q in hnsw.near_duplicates(df, shard=shard).collect()]
    assert sorted(got) == sorted(want)
    again = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [0.0, 1.0], 5), (None, [0.0, 1.0], 5)], "vec_id long, embedding array<float>, label int")
    assert Counter(tuple(q) for q in hnsw.near_duplicates(again).collect()) == Counter([(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)])


def test_audit_widens_beams():
    r = np.random.default_rng(3)
    g = hnsw.Graph.build(hnsw.unit(r.normal(size=(3000, 48))))
    q = hnsw.moved(g.x, 0.985)
    f = hnsw.Found(g, q, np.ones(3000, int), np.ones(3000, int), 0.98, hnsw.beam_width(g, q, 0.98))
    assert f.n_q.sum() >= 0.985 * 3000 and len(f.forest()[0]) == f.n_q.sum()


def test_graph_recall():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    g = hnsw.Graph.build(x)
    q = x[:100]
    true = np.argsort(-(q @ x.T), axis=1)[:, :5]
    ids, _ = g.search(q, 200)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(true.tolist(), ids.tolist())]) > 0.9


def test_nearest_is_exact():
    r = random.Random(2)
    vecs = []
    for _ in range(400):
        t = sorted(r.sample(range(50), r.randint(0, 6)))
        vecs.append((np.array(t, np.int64), np.array([r.randint(1, 4) for _ in t], float)))
    idf = np.linspace(1, 5, 50)
    ix = toxicity.Index(list(range(400)), np.array([i % 2 for i in range(400)], float), vecs, idf)
    dense = np.zeros((len(ix.vectors), 50))
    for i, (t, w) in enumerate(ix.vectors):
        dense[i, t] = w
    for t, n in vecs[:60]:
        if len(t):
            q = np.zeros(50)
            q[t] = ix.unit(t, n)
            s = dense @ q
            at, sim = ix.nearest(t, ix.unit(t, n), 7)
            assert np.allclose(sim, np.sort(s)[::-1][: len(sim)]) and len(sim) == min(7, int((s > 0).sum()))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    r = toxicity.op9_toxicity(spark, sf).join(read("labels"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = sum(x.toxic and x.predicted for x in r)
    assert hit / sum(x.predicted for x in r) > 0.9 and hit / sum(x.toxic for x in r) > 0.75
    assert all(0 <= x.score <= 1 for x in r)


def test_toxicity_odd_tables(spark, docs):
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), labels.limit(0)).count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def brute_removed(texts):
    first = {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = {}
    for d, t in texts.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("local,chunk", [(suffixes.LOCAL, suffixes.CHUNK), (1, 4000)])
def test_suffix_dedup(spark, monkeypatch, local, chunk):
    monkeypatch.setattr(suffixes, "LOCAL", local)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    texts = {r[0]: r[1] for r in corpus(90, 9)}
    texts[500], texts[501] = "ab" * 200, "x" + "ab" * 100 + "y" * 60
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digests(df).collect()}
    assert got == brute_removed(texts)


@pytest.mark.parametrize("low,equal", [(7, True), (8, False)])
def test_windows_of_a_chunk_are_compared_by_all_bits(monkeypatch, low, equal):
    class OneChunk:
        first = last = np.array([0, 50])
        at, cover, need = np.array([0, 1, 2]), np.zeros(0, np.int64), np.array([0, 1])
        buf, off = np.frombuffer(b"a" * 50 + b"b" * 50, np.uint8), np.array([0, 50, 100])
        table = pa.table({"doc_id": [1, 2]})

    high = 5 << 24  # the upper 40 bits agree
    monkeypatch.setattr(suffixes, "Chunk", lambda path: OneChunk())
    monkeypatch.setattr(suffixes, "windows_of", lambda buf, first, last: (first, np.array([high + 7, high + low], np.uint64), np.array([1, 1])))
    asked = suffixes._window_pass(1)(pa.Table.from_batches([suffixes._row([(suffixes.CHUNKED, 0, 0, "p", b"")])]))
    sent = [suffixes.unpack(b, True)[4].tolist() for k, b in zip(asked.column("kind").to_pylist(), asked.column("payload").to_pylist()) if k == suffixes.SENT]
    assert sent == ([[0]] if equal else [[0, 1]])
    own = pa.Table.from_batches([b for b in asked.to_batches() if b.column(0)[0].as_py() == suffixes.CHUNKED])
    _, gone = suffixes._removed(own)
    assert gone.tolist() == [False] * 50 + [equal] * 50


def test_suffix_cut_keeps_columns_and_characters(spark):
    p = "é" * 40
    rows = [(1, p + "a", "en", "s", 41), (2, "b" + p + "ñ", "de", "t", 42), (None, p, "x", "y", 40), (1, p, "r", "r", 40), (3, None, "n", "n", None)]
    out = suffixes.deduplicated(spark.createDataFrame(rows, DOCS))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == Counter([(1, p + "a", 41), (2, "bñ", 2), (None, p, 40), (1, p, 40), (3, None, None)])
    assert suffixes.digests(empty(spark, ", chunk long")).count() == 0


def test_family_merges_levels():
    f, n = suffixes.Family(), 0
    r = np.random.default_rng(0)
    for i in range(16):
        k = r.integers(0, 4000, 100).astype(np.uint64)
        f.add(k, k, np.full(100, i), np.zeros(100, bool), np.zeros(100, np.int64), np.arange(100))
        n += 100
        assert len(f.levels) <= 6 and sum(len(lv[0]) for lv in f.levels) == n
    every = np.concatenate([lv[0] for lv in f.levels])
    u, c = np.unique(every, return_counts=True)
    assert len(f.met()[0]) == c[c > 1].sum()


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3)], "a long, b long")
    assert {r.node: r.root for r in common.components(e).collect()} == {4: 3, 5: 3, 9: 8}


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "ONE_TASK", 0)
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a long, b long").repartition(4)
    assert {r.node: r.root for r in common.components(e).collect()} == {i: 0 for i in range(1, 41)} | {100: 90}
