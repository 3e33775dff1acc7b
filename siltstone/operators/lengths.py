"""Length profiles, sequential packing, strata and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contamination import nearest_rank

SEQUENCE = 4096


def greedy_pack(df: DataFrame, by: list[str], order: str, length: str, capacity: int = SEQUENCE) -> DataFrame:
    """Sequential packing in each group: a bin closes when the next item doesn't fit; longer items are cut and counted.

    A fold over the group's lengths in order; only lengths are gathered, so a
    group is one array of numbers.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(length).cast("long").alias("_l")))), lambda x: x["_l"])
    cap = F.lit(capacity).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("bins"), F.lit(0).cast("long").alias("cur"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("cut"))

    def step(a: Column, x: Column) -> Column:
        n = F.least(x, cap)
        full = a["cur"] + n > cap
        return F.struct((a["bins"] + full.cast("long")).alias("bins"), F.when(full, n).otherwise(a["cur"] + n).alias("cur"), (a["used"] + n).alias("used"), (a["cut"] + (x > cap).cast("long")).alias("cut"))

    g = df.groupBy(*by).agg(F.count("*").alias("examples"), F.aggregate(items, start, step).alias("p"))
    bins = F.col("p.bins") + (F.col("p.cur") > 0).cast("long")
    return g.select(*by, "examples", bins.alias("sequences"), F.col("p.used").alias("tokens"), F.col("p.cut").alias("truncated"), (F.lit(1.0) - F.try_divide("p.used", bins * cap)).alias("padding"))


def profile(df: DataFrame, by: list[str], length: str, over: tuple[int, ...] = (512, 1024, 2048, 4096)) -> DataFrame:
    """Nearest-rank p50, p90, p99, the maximum and the shares over some lengths."""
    q = nearest_rank(df, length, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by)
    s = df.groupBy(*by).agg(F.max(length).alias("longest"), *((F.count_if(F.col(length) > x) / F.count("*")).alias(f"over_{x}") for x in over))
    return q.join(s, by)


def strata(df: DataFrame, value: str) -> DataFrame:
    """Adds ``stratum``: zero, low (to the median of positive values) or high."""
    m = nearest_rank(df.where(F.col(value) > 0), value, {"m": 0.5}).select("m")
    return df.join(F.broadcast(m), how="left").withColumn("stratum", F.when(F.col(value) == 0, "zero").when(F.col(value) <= F.col("m"), "low").otherwise("high")).drop("m")  # m: one row


def terciles(df: DataFrame, value: str, out: str = "tercile") -> DataFrame:
    t = nearest_rank(df, value, {"t1": 1 / 3, "t2": 2 / 3}).select("t1", "t2")
    return df.crossJoin(F.broadcast(t)).withColumn(out, F.when(F.col(value) <= F.col("t1"), 1).when(F.col(value) <= F.col("t2"), 2).otherwise(3)).drop("t1", "t2")  # one row


def tail(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median v[n // 2], p99 v[min(n - 1, int(.99 n))] and the share of the total above it, by rank."""
    w = Window.partitionBy(*by)
    d = df.select(*by, value).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    cut = F.floor(F.col("_n") * 99 / 100)
    return d.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col(value))).alias("median"),
        F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, cut), F.col(value))).alias("p99"),
        F.try_divide(F.coalesce(F.sum(F.when(F.col("_r") >= cut, F.col(value))), F.lit(0)), F.sum(value)).alias("top_share"),
    )


def schedule(packed: DataFrame, by: list[str], batch: int = 16) -> DataFrame:
    """Equal steps for all groups: the least number of sequences by ``batch``, and what each group leaves."""
    steps = packed.agg(F.floor(F.min("sequences") / batch).alias("steps"))
    return packed.crossJoin(F.broadcast(steps)).withColumn("leftover", F.col("sequences") - F.col("steps") * batch)  # one row


def learning_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, then a half cosine."""
    x = (step - warmup) / F.greatest(F.lit(total - warmup), F.lit(1))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / max(warmup, 1)).otherwise(F.lit(peak) * 0.5 * (1 + F.cos(F.pi() * x)))


def remaining_context(longest: int, prompt: Column) -> Column:
    return F.greatest(F.lit(1), F.lit(longest) - prompt - 8)
