"""Mechanical scoring of outputs: validity, exact match, per-field scores, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import metric_of

#: CVSS v3.1 metric weights.
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}
AC = {"L": 0.77, "H": 0.44}
PR_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
UI = {"N": 0.85, "R": 0.62}
CIA = {"H": 0.56, "L": 0.22, "N": 0.00}


def _weight(v: Column, key: str, table: dict[str, float]) -> Column:
    out = None
    for k, w in table.items():
        hit = metric_of(v, key) == k
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return out


def cvss31(vector: Column) -> Column:
    """CVSS v3.1 base score of a vector; null for a malformed one.  Rounds up on integers, as the standard asks."""
    v = F.upper(F.trim(vector))
    m = v  # a metric that comes twice has its last value
    scope = metric_of(m, "S")
    changed = scope == "C"
    c, i, a = (_weight(m, k, CIA) for k in "CIA")
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    expl = 8.22 * _weight(m, "AV", AV) * _weight(m, "AC", AC) * F.when(changed, _weight(m, "PR", PR_CHANGED)).otherwise(_weight(m, "PR", PR_UNCHANGED)) * _weight(m, "UI", UI)
    raw = F.least(F.when(changed, 1.08).otherwise(1.0) * (impact + expl), F.lit(10.0))
    n = F.rint(raw * 100000).cast("long")
    up = F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000) + 1) / 10.0)
    fine = v.rlike(r"^CVSS:3\.1(/[A-Z]+:[A-Z]+)+$") & scope.isin("U", "C") & impact.isNotNull() & expl.isNotNull()
    return F.when(fine, F.when(impact <= 0, 0.0).otherwise(up))


def exact_id(pred: Column, target: Column) -> Column:
    return F.coalesce(T.norm_id(pred) == T.norm_id(target), F.lit(False))


def parse_flags(output: Column, one_key: str | None = None) -> dict[str, Column]:
    """Whether an output parses as JSON, and whether it is an object with exactly the text key ``one_key``."""
    clean = T.unfenced(output)
    v = F.try_parse_json(clean)
    kind = F.schema_of_variant(v)
    ok = v.isNotNull()
    out = {"parsed": F.coalesce(ok, F.lit(False))}
    if one_key:
        out["schema_valid"] = F.coalesce(kind == f"OBJECT<{one_key}: STRING>", F.lit(False))
    return out


def extraction(pred_versions: Column, target_versions: Column) -> dict[str, Column]:
    """tp, fp and fn of folded, non-empty version sets."""
    s = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.folded), lambda x: x.isNotNull()))
    p, t = s(pred_versions), s(target_versions)
    return {"tp": F.size(F.array_intersect(p, t)), "fp": F.size(F.array_except(p, t)), "fn": F.size(F.array_except(t, p))}


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Micro precision, recall and F1; a zero denominator gives 0."""
    z = F.lit(0.0)
    return {"precision": F.coalesce(F.try_divide(tp, tp + fp), z), "recall": F.coalesce(F.try_divide(tp, tp + fn), z), "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), z)}


def rates(df: DataFrame, by: list[str], flag: str, valid: str | None = None) -> DataFrame:
    """n, k and rate of a flag, and the rate among valid rows; empty groups have rate 0."""
    k = F.count_if(F.col(flag))
    aggs = [F.count("*").alias("n"), k.alias("k"), F.coalesce(F.try_divide(k, F.count("*")), F.lit(0.0)).alias("rate")]
    if valid:
        kv = F.count_if(F.col(flag) & F.col(valid))
        aggs += [F.count_if(F.col(valid)).alias("n_valid"), F.coalesce(F.try_divide(kv, F.count_if(F.col(valid))), F.lit(0.0)).alias("rate_valid")]
    return df.groupBy(*by).agg(*aggs)


def collapse(df: DataFrame, by: list[str], pos: str, reward: str, size: int = 8) -> DataFrame:
    """Groups of ``size`` consecutive completions: collapsed if all rewards are equal; population deviation of each."""
    g = df.withColumn("group", F.floor(F.col(pos) / size).cast("long")).groupBy(*by, "group")
    return g.agg(F.count("*").alias("n"), (F.min(reward) == F.max(reward)).alias("collapsed"), F.stddev_pop(reward).alias("deviation"), F.avg(reward).alias("mean"))
