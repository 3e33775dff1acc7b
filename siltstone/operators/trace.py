"""Traceability: figures resolve to recorded values, and texts hold no other figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def resolve(document: Column, path: list[str | int]) -> Column:
    """The value at a path of a JSON text; null if there is none."""
    return F.get_json_object(document, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def rendered(value: Column, kind: str) -> Column:
    """A figure as texts show it: n, pct, pp, p or s."""
    if kind == "n":
        return F.format_number(value, 0)
    if kind == "pct":
        return F.concat(F.format_number(value * 100, 1), F.lit(" %"))
    if kind == "pp":
        return F.concat(F.when(value >= 0, "+").otherwise("-"), F.format_number(F.abs(value) * 100, 1), F.lit(" pp"))
    if kind == "p":
        return F.when(value < 0.0001, "< 0.0001").otherwise(F.format_number(value, 4))
    return value.cast("string")


def changed(recorded: DataFrame, resolved: DataFrame, key: str, value: str) -> DataFrame:
    """Recorded figures that resolve to something else now, or to nothing."""
    j = recorded.select(key, F.col(value).alias("recorded")).join(resolved.select(key, F.col(value).alias("now")), key, "left")
    return j.where(~F.col("recorded").eqNullSafe(F.col("now")))


def untraced(texts: DataFrame, registry: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """Distinct numeric literals of texts that the registry doesn't hold."""
    n = texts.select(key, F.explode(F.array_distinct(T.numbers(F.col(text)))).alias(literal))
    return n.join(registry.select(literal).distinct(), literal, "left_anti").select(key, literal)


def gate(required: DataFrame, results: DataFrame, check: str, status: str) -> DataFrame:
    """Adds ``met``: each required check passed, or passed with a warning; missing ones are unmet."""
    return required.join(results.select(check, status), check, "left").withColumn("met", F.coalesce(F.col(status).isin("pass", "warn"), F.lit(False)))


def calculated(op: str, *values: Column) -> Column:
    """A derived figure: sum, diff, ratio, product, hours, minutes, gib or pct_ratio."""
    a, b = values[0], values[1] if len(values) > 1 else None
    return {
        "sum": lambda: sum(values[1:], a), "diff": lambda: a - b, "ratio": lambda: F.try_divide(a, b), "product": lambda: a * b,
        "hours": lambda: a / 3600, "minutes": lambda: a / 60, "gib": lambda: a / (1 << 30), "pct_ratio": lambda: 100 * F.try_divide(a, b),
    }[op]()


def near_boundary(rate: Column, n: Column) -> Column:
    """True where a rate is within three standard errors of 0 or 1, so a normal approximation says nothing."""
    se = F.sqrt(rate * (1 - rate) / n)
    return (rate - 3 * se <= 0) | (rate + 3 * se >= 1)


def agreement(a: DataFrame, b: DataFrame, key: list[str], diff: str, verdict: str) -> DataFrame:
    """Two seeds' comparisons side by side: same sign, same verdict, or opposite signs that both claim a difference."""
    j = a.select(*key, F.col(diff).alias("da"), F.col(verdict).alias("va")).join(b.select(*key, F.col(diff).alias("db"), F.col(verdict).alias("vb")), key)
    claims = F.col("va").isin("a is better", "b is better") & F.col("vb").isin("a is better", "b is better")
    return j.withColumns({"same_sign": F.signum("da") == F.signum("db"), "same_verdict": F.col("va") == F.col("vb"), "conflict": claims & (F.signum("da") != F.signum("db"))})


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table."""
    rows = df.limit(limit).collect()
    line = lambda v: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in v) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])
