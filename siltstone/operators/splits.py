"""Order-independent sampling, temporal splits and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_int

WIDE = 1 << 62


def hash_sample(df: DataFrame, key: str, n: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """The n rows with the smallest stable hash of seed and key (in each stratum ``by``); ties by key."""
    d = df.withColumn("_h", stable_int(F.concat(F.lit(seed), F.col(key).cast("string")), WIDE))
    if not by:
        return d.orderBy("_h", key).limit(n).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", key)
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_h", "_n")


def period(date: Column, cutoff: str, years: tuple[str, ...]) -> Column:
    """Temporal period of an ISO date text: texts compare as dates do."""
    return F.when(date.isNull(), "no_date").when(date >= cutoff, "post").when(F.substring(date, 1, 4).isin(*years), "pre").otherwise("other")


def temporal_split(df: DataFrame, key: str, date: str, eligible: Column, cutoff: str, years: tuple[str, ...], seed: str, cap: int | None = 5000) -> DataFrame:
    """Adds ``split``: equal samples of both periods for evaluation, the later rest unused, other eligible rows train."""
    d = df.withColumn("period", F.when(eligible, period(F.col(date), cutoff, years)).otherwise("excluded"))
    n = d.agg(F.least(F.count_if(F.col("period") == "post"), F.count_if(F.col("period") == "pre"), *([F.lit(cap)] if cap else [])).alias("n")).first()["n"]
    d = d.withColumn("_h", stable_int(F.concat(F.lit(seed), F.col(key).cast("string")), WIDE))
    pick = [d.where(F.col("period") == p).orderBy("_h", key).limit(n).select(key, F.lit(f"eval_{p}").alias("_e")) for p in ("post", "pre")] if n else []
    split = F.when(F.col("period").isin("excluded", "no_date"), "excluded").when(F.col("period") == "post", "unused").otherwise("train")
    if not pick:
        return d.withColumn("split", split).drop("_h")
    chosen = pick[0].union(pick[1])
    return d.join(chosen, key, "left").withColumn("split", F.coalesce("_e", split)).drop("_h", "_e")


def quotas(counts: DataFrame, stratum: str, n: int) -> DataFrame:
    """Proportional quota of ``n`` for each stratum, half-even; what rounding leaves goes to the last."""
    w = Window.orderBy(stratum)
    every = Window.partitionBy(F.lit(1))
    d = counts.withColumn("quota", F.rint(F.lit(n) * F.col("count") / F.sum("count").over(every)).cast("long"))
    last = F.row_number().over(w) == F.count("*").over(every)
    return d.withColumn("quota", F.when(last, F.lit(n) - (F.sum("quota").over(every) - F.col("quota"))).otherwise(F.col("quota")))


def budget_prefix(df: DataFrame, key: str, tokens: str, budget: Column | int, seed: str, by: list[str] | None = None) -> DataFrame:
    """Rows in stable-hash order until the budget is passed; the first always stays.  Adds ``running``."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    h = stable_int(F.concat(F.lit(seed), F.col(key).cast("string")), WIDE)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_h", key)
    d = df.withColumn("_h", h).withColumn("running", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return d.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_h", "_n")


def replay_budget(domain_tokens: int, share: float = 0.20) -> int:
    return int(domain_tokens * share / (1 - share))


def integrity(splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys with more than one split label; none are expected."""
    return splits.groupBy(key).agg(F.count_distinct(split).alias("labels")).where("labels > 1")


def not_scored_reason(n: Column) -> Column:
    """Half-width of a 95 % interval at a rate of one half."""
    return F.lit(1.96) * F.sqrt(F.lit(0.25) / n)


def first_sorted(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by key: a limited scan, not a sample.  Spark keeps ``n`` rows of a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(key)
    return df.where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
