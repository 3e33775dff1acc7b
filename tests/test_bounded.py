"""Operators that hold little at once."""

import tracemalloc

import numpy as np
import pytest

from siltstone.operators import stats


def test_bootstrap_holds_no_matrix_of_draws():
    x = (np.arange(20000) % 3 > 0).astype(np.int8)
    tracemalloc.start()
    got = stats.boot_ci(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pick = np.random.default_rng(stats.SEED).integers(0, 20000, size=(stats.RESAMPLES, 20000))
    assert got == tuple(np.percentile(x.astype(float)[pick].mean(axis=1), [2.5, 97.5])) and peak < 20e6


def test_paired_difference_holds_no_matrix_of_draws(spark, monkeypatch):
    rows = [(g, i, i % 3 > 0, i % 5 > 0) for i in range(300) for g in ("x", None)]
    df = spark.createDataFrame(rows[::-1], "g string, k long, a boolean, b boolean")
    d = np.array([float(i % 3 > 0) - float(i % 5 > 0) for i in range(300)])
    means = d[np.random.default_rng(stats.SEED).integers(0, 300, size=(stats.RESAMPLES, 300))].mean(axis=1)
    for r in stats.paired_difference(df, ["g"], "k", "a", "b").collect():
        assert (r.n, r["diff"], r.lo, r.hi, r.se) == (300, *(pytest.approx(v, rel=1e-12) for v in (d.mean(), *np.percentile(means, [2.5, 97.5]), means.std(ddof=1))))
    monkeypatch.setattr(stats, "DRAWS", 100)  # blocks draw what whole rows draw
    assert np.array_equal(stats.boot_means(d.astype(np.int8)), means)
