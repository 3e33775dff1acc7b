"""Paired statistics: bootstrap intervals, McNemar, Holm, matched controls, reweighting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Normal quantiles of 0.975 and 0.8, resamples and seed.
Z_ALPHA, Z_POWER, RESAMPLES, SEED = 1.959963985, 0.8416212336, 1000, 1234
#: Draws of a bootstrap held at once.
DRAWS = 1 << 18


def boot_means(values, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """Means of the resamples that ``integers(0, n, (resamples, n))`` draws; only one row of draws is held, of whole numbers a block."""
    a = np.asarray(values)
    n, r = len(a), np.random.default_rng(seed)
    if a.dtype == np.int8:  # sums are exact in any order
        blocks = [min(DRAWS, n - i) for i in range(0, n, DRAWS)]
        return np.array([sum(int(a[r.integers(0, n, size=m)].sum(dtype=np.int64)) for m in blocks) / n for _ in range(resamples)])
    return np.array([a[r.integers(0, n, size=n)].mean() for _ in range(resamples)])


def boot_ci(flags, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float | None, float | None]:
    """Percentile bootstrap interval of a mean; a fresh generator for each call."""
    a = np.asarray(flags)
    if not len(a):
        return None, None
    lo, hi = np.percentile(boot_means(a if a.dtype == np.int8 else a.astype(np.float64), resamples, seed), [2.5, 97.5])
    return float(lo), float(hi)


def _by_group(df: DataFrame, by: list[str], key: str, value: Column, row, types: str) -> DataFrame:
    """``row`` of each group's values in key order (null keys last), which travel packed, so that a group has a few bytes for a row.

    -1, 0 and 1 take a byte and reach ``row`` as int8; other values and nulls make the group's doubles.
    """
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, BooleanType, LongType, StructType

    d = df.select(*by, F.col(key).alias("_k"), value.cast("double").alias("_v"))
    d = d.repartitionByRange(*by, F.col("_k").asc_nulls_last()).sortWithinPartitions(*by, F.col("_k").asc_nulls_last())
    d = d.withColumn("_p", F.spark_partition_id().cast("long")).select(*by, "_p", "_v")
    n = len(by)
    packed = StructType([df.schema[b] for b in by]).add("_p", LongType()).add("_i", LongType()).add("_small", BooleanType()).add("_n", LongType()).add("_b", BinaryType())

    def pack(batches):
        i = 0
        for batch in batches:
            keys = [c.to_pylist() for c in batch.columns[:n]]
            same = [j for j in range(1, batch.num_rows) if any(k[j] != k[j - 1] for k in keys)]
            v = batch.column(n + 1).to_numpy(zero_copy_only=False)
            out = []
            for x, y in zip([0, *same], [*same, batch.num_rows]) if batch.num_rows else []:
                small = bool(np.isin(v[x:y], (-1, 0, 1)).all())
                out.append([*(k[x] for k in keys), batch.column(n)[x].as_py(), i, small, y - x, v[x:y].astype(np.int8 if small else np.float64).tobytes()])
                i += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*batch.schema.types[:n], pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()])], [*by, "_p", "_i", "_small", "_n", "_b"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "_i"])
        kind = np.int8 if pdf["_small"].all() else np.float64
        v = np.empty(int(pdf["_n"].sum()), kind)
        at = 0
        for small, m, b in zip(pdf["_small"], pdf["_n"], pdf["_b"]):
            v[at : at + m] = np.frombuffer(b, np.int8 if small else np.float64)
            at += m
        return pd.DataFrame([[*(pdf[b].iloc[0] for b in by), *row(v)]], columns=out_names)

    keys = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
    out_names = [*by, *(x.split()[0] for x in types.split(", "))]
    return d.mapInArrow(pack, packed).groupBy(*by).applyInPandas(one, f"{keys}, {types}")


def with_ci(df: DataFrame, by: list[str], key: str, flag: str) -> DataFrame:
    """n, k, rate and the bootstrap interval of each group; values are in key order inside, so the rows' order doesn't matter."""

    def row(x: np.ndarray) -> list:
        return [len(x), int(np.nansum(x)), float(pd.Series(x).mean()), *boot_ci(x)]

    return _by_group(df, by, key, F.col(flag), row, "n long, k long, rate double, lo double, hi double")


def mdd(p: Column, n: Column) -> Column:
    """Least detectable difference of two proportions (5 %, power 0.8)."""
    return F.when((n > 0) & p.isNotNull(), F.lit(Z_ALPHA + Z_POWER) * F.sqrt(F.greatest(2 * p * (1 - p), F.lit(1e-12)) / n))


def mcnemar_p(b: int, c: int) -> float:
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


@F.pandas_udf(DoubleType())
def _mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c)])


def discordance(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """paired items, a_only, b_only and discordant of paired flags."""
    return pairs.groupBy(*by).agg(F.count("*").alias("paired"), F.count_if(F.col(a) & ~F.col(b)).alias("a_only"), F.count_if(~F.col(a) & F.col(b)).alias("b_only")).withColumn("discordant", F.col("a_only") + F.col("b_only"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """Adds p and the method: exact below 25 discordant pairs, else corrected chi-square."""
    n = F.col("discordant")
    how = F.when(n == 0, "no discordant pairs").when(n < 25, "exact binomial").otherwise("chi-square with continuity correction")
    return counts.withColumn("p", _mcnemar("a_only", "b_only")).withColumn("method", how)


def paired_difference(pairs: DataFrame, by: list[str], key: str, a: str, b: str) -> DataFrame:
    """Mean paired difference with its bootstrap interval, standard error and paired detectable difference."""

    def row(d: np.ndarray) -> list:
        means = boot_means(d)
        disc = float((d != 0).mean())
        return [len(d), float(d.mean()), *map(float, np.percentile(means, [2.5, 97.5])), float(means.std(ddof=1)), (Z_ALPHA + Z_POWER) * math.sqrt(max(disc, 1e-12) / len(d))]

    return _by_group(pairs, by, key, F.col(a).cast("double") - F.col(b).cast("double"), row, "n long, diff double, lo double, hi double, se double, mdd double")


def holm(df: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """Adds ``adjusted``: Holm's step-down p within each family; null p stay null and don't count."""
    real = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    r = real.withColumn("_i", F.row_number().over(w.orderBy(p, key)) - 1).withColumn("_m", F.count("*").over(w))
    r = r.withColumn("_a", F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p)))
    r = r.withColumn("adjusted", F.max("_a").over(w.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m", "_a")
    return r.unionByName(df.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def paired_verdict(diff: Column, p: Column, alpha: float = 0.05) -> Column:
    """What a paired test says; interval overlap never decides paired data."""
    return F.when(p.isNull(), "not tested").when(p >= alpha, "no difference detected").when(diff > 0, "a is better").when(diff < 0, "b is better").otherwise("no difference detected")


def unpaired_verdict(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.when(alo > bhi, "a is higher").when(blo > ahi, "b is higher").otherwise("intervals overlap")


def contradictions(df: DataFrame, verdict: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Rows whose verdict contradicts their p."""
    claims = F.col(verdict).isin("a is better", "b is better")
    return df.where((claims & (F.col(p) >= alpha)) | (~claims & (F.col(p) < alpha)))


def reweighted(a: DataFrame, b: DataFrame, label: str, flag: str) -> DataFrame:
    """Accuracy on ``b`` under ``a``'s label mix, with the mass of labels that both have; one row."""
    x = a.groupBy(label).agg(F.count("*").alias("w"))
    y = b.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k"))
    j = x.join(y, label, "left")
    have = F.col("n").isNotNull()
    return j.agg(
        F.try_divide(F.sum(F.when(have, F.col("w") * F.col("k") / F.col("n"))), F.sum(F.when(have, F.col("w")))).alias("accuracy"),
        F.try_divide(F.coalesce(F.sum(F.when(have, F.col("w"))), F.lit(0)), F.sum("w")).alias("covered"),
    )


def matched_controls(cases: DataFrame, controls: DataFrame, by: list[str], key: str, size: str) -> DataFrame:
    """One control for each case, greedily in key order: same ``by``, nearest size, ties to the smaller key, each control once.

    Pools are disjoint by ``by``, so groups match independently.
    """
    both = cases.select(*by, F.col(key).alias("k"), F.col(size).alias("s"), F.lit(True).alias("case")).union(controls.select(*by, key, size, F.lit(False)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        pool = sorted(zip(pdf[~pdf.case].s, pdf[~pdf.case].k))
        out = []
        for k, s in sorted(zip(pdf[pdf.case].k, pdf[pdf.case].s)):
            if not pool:
                break
            i = bisect.bisect_left(pool, (s,))
            best = min((abs(pool[j][0] - s), pool[j][1], j) for j in _near(pool, i, s))
            out.append((*(pdf[b].iloc[0] for b in by), k, best[1]))
            pool.pop(best[2])
        return pd.DataFrame(out, columns=[*by, "case_key", "control_key"])

    types = ", ".join(f"`{b}` {cases.schema[b].dataType.simpleString()}" for b in by)
    t = cases.schema[key].dataType.simpleString()
    return both.groupBy(*by).applyInPandas(one, f"{types}, case_key {t}, control_key {t}")


def _near(pool: list, i: int, s) -> list[int]:
    """Positions that can be nearest to s in a sorted pool: the next above, and the first of the size below."""
    out = []
    if i < len(pool):
        out.append(i)
    if i > 0:
        import bisect

        out.append(bisect.bisect_left(pool, (pool[i - 1][0],)))
    return out


def run_diff(a: DataFrame, b: DataFrame, key: list[str], text: str) -> DataFrame:
    """Keys whose text differs or is missing in one of two runs."""
    x, y = a.select(*key, F.col(text).alias("left")), b.select(*key, F.col(text).alias("right"))
    return x.join(y, key, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
