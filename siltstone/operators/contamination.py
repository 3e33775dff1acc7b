"""Overlap of evaluation texts with training texts: n-gram coverage and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def gram_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """A row for each n-gram of each text: key, pos, gram."""
    return df.select(key, F.posexplode(T.ngrams(T.words(F.col(text)), n)).alias("pos", "gram"))


def gram_index(train: DataFrame, text: str, n: int) -> DataFrame:
    """Distinct n-grams of the training texts, as 128 bits of hash."""
    return train.select(F.explode(F.array_distinct(T.ngrams(T.words(F.col(text)), n))).alias("gram")).select(F.xxhash64("gram").alias("h"), F.crc32("gram").alias("c")).distinct()


def coverage(evals: DataFrame, train: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, n_grams, n_hit, coverage and the first hit gram: hits count with repeats; texts without grams have coverage 0.

    The few evaluation grams, distinct, meet the corpus's grams in one join, so
    the corpus is never shuffled as a whole: its grams are filtered by a semi
    join against the evaluation side first.
    """
    g = gram_rows(evals, key, text, n)
    wanted = g.select("gram").distinct()
    hits = train.select(F.explode(F.array_distinct(T.ngrams(T.words(F.col(text)), n))).alias("gram")).join(wanted, "gram", "left_semi").distinct().withColumn("hit", F.lit(True))
    per = g.join(hits, "gram", "left").groupBy(key).agg(F.count("*").alias("n_grams"), F.count_if(F.col("hit")).alias("n_hit"), F.min_by("gram", F.when(F.col("hit"), F.col("pos"))).alias("first_hit"))
    out = evals.select(key).distinct().join(per, key, "left")
    zero = F.lit(0).cast("long")
    return out.select(key, F.coalesce("n_grams", zero).alias("n_grams"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.try_divide("n_hit", "n_grams"), F.lit(0.0)).alias("coverage"), F.when(F.col("n_hit") > 0, F.col("first_hit")).alias("first_hit"))


def nearest(evals: DataFrame, train: DataFrame, key: str, other: str, text: str, k: int = 5) -> DataFrame:
    """For each evaluation text the training text with the best shingle Jaccard; ties to the smaller key, null if nothing is shared."""
    e = evals.select(F.col(key), T.shingles(T.words(F.col(text)), k).alias("s"))
    t = train.select(F.col(other), T.shingles(T.words(F.col(text)), k).alias("s"))
    ei = e.select(key, F.size("s").alias("ne"), F.explode("s").alias("g"))
    ti = t.select(other, F.size("s").alias("nt"), F.explode("s").alias("g"))
    wanted = ei.select("g").distinct()
    p = ti.join(wanted, "g", "left_semi").join(ei, "g").groupBy(key, other).agg(F.count("*").alias("shared"), F.first("ne").alias("ne"), F.first("nt").alias("nt"))
    best = p.withColumn("jaccard", F.col("shared") / (F.col("ne") + F.col("nt") - F.col("shared"))).groupBy(key).agg(F.max(F.struct("jaccard", (-F.col(other)).alias("o"))).alias("b"))
    return evals.select(key).distinct().join(best, key, "left").select(key, (-F.col("b.o")).alias("nearest"), F.coalesce("b.jaccard", F.lit(0.0)).alias("jaccard"))


def nearest_rank(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank quantiles: the value at half-even rounded q * (n - 1), a column for each of ``qs``.

    Values are counted first, so a column with few distinct values sorts few rows.
    """
    by = by or []
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(by or [F.lit(1)]))
    c = c.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda q: F.min(F.when(F.col("_to") > F.rint(F.lit(q) * (F.col("_n") - 1)), F.col(value)))
    return c.groupBy(*by).agg(*(at(q).alias(name) for name, q in qs.items()), F.max("_n").alias("n"))


def quartile(v: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Quartile 1 to 4; ties fall low."""
    return F.when(v <= q25, 1).when(v <= q50, 2).when(v <= q75, 3).otherwise(4)


def histogram(v: Column, edges: list[float]) -> Column:
    """Label of the half-open bin that holds v; the last bin is closed."""
    out = F.when(F.lit(False), "")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (v >= lo) & ((v <= hi) if i == len(edges) - 2 else (v < hi))
        out = out.when(inside, f"[{lo:g},{hi:g})")
    return out


def tvd(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Total variation distance of two categorical distributions, one row; an empty side counts as zeros."""
    share = lambda d, n: d.groupBy(key).agg(F.count("*").alias(n))
    j = share(a, "_x").join(share(b, "_y"), key, "full_outer").select(F.coalesce("_x", F.lit(0)).alias("x"), F.coalesce("_y", F.lit(0)).alias("y"))
    tot = j.agg(F.greatest(F.sum("x"), F.lit(1)).alias("sx"), F.greatest(F.sum("y"), F.lit(1)).alias("sy"))
    # over a common denominator the sum is one of integers
    return j.crossJoin(F.broadcast(tot)).agg((F.sum(F.abs(F.col("x") * F.col("sy") - F.col("y") * F.col("sx"))) / (F.lit(2) * F.first("sx") * F.first("sy"))).alias("tvd"))  # tot: one row


def verdict(j: Column, threshold: float = 0.75) -> Column:
    return F.when(j >= threshold, "removed").otherwise("kept")
