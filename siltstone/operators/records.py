"""Records before they become examples: text and metric choice, completeness, reply filters, two-source tables, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics of a severity vector, in order.
METRICS = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]
#: Substrings of a licence name that mark it as copyleft.
COPYLEFT = ["GPL", "MPL", "EPL", "CDDL"]


def text_of(lead: list[Column], rest: list[Column]) -> Column:
    """The non-empty ``lead`` fields (title, name, description, extended description) on lines of their own; without any, all of ``rest``."""
    lines = lambda cs: F.array_join(F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != "")), "\n")
    first = lines(lead)
    return F.when(first != "", first).otherwise(lines(rest))


def primary_metric(df: DataFrame, key: str, kind: str, order: str, values: list[str]) -> DataFrame:
    """For each key the first entry of type ``Primary``, else the first entry; one aggregate, combined before its shuffle."""
    rank = F.struct(F.when(F.col(kind) == "Primary", 0).otherwise(1).alias("_r"), F.col(order).alias("_o"), F.col(kind).alias("picked"), *values)
    return df.groupBy(key).agg(F.min(rank).alias("m")).select(key, "m.picked", *(f"m.{v}" for v in values))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does.  A null condition doesn't hold."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))


def replay_reason(message: dict[str, Column], parent: dict[str, Column], langs: list[str], least: int = 8) -> Column:
    """Why a reply makes no training pair, by the first rule that it breaks; null for a pair."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return first_reason([
        ("deleted", no(message["deleted"])),
        ("failed_review", F.coalesce(~message["review"], F.lit(False))),
        ("synthetic_model_generated", no(message["synthetic"])),
        ("language", ~F.coalesce(message["lang"].isin(langs), F.lit(False))),
        ("no_prompter_parent", ~parent["role"].eqNullSafe("prompter")),
        ("parent_synthetic_or_deleted", no(parent["synthetic"]) | no(parent["deleted"])),
        ("too_short", (F.length(F.coalesce(parent["text"], F.lit(""))) < least) | (F.length(F.coalesce(message["text"], F.lit(""))) < least)),
    ])


def choice(choices: Column, gold: Column, n: int = 4) -> Column:
    """The right choice of an item with exactly ``n`` choices and a gold index among them; null otherwise."""
    return F.when((F.size(choices) == n) & (gold >= 0) & (gold < n), F.get(choices, gold.cast("int")))


def two_sources(main: DataFrame, other: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Full outer table of two sources: the state is the main source's, its date falls back to the other's, decisions are the main source's.

    ``main(key, state, date)``, ``other(key, date)``, ``decisions(key, keep, stage)``; without a decision a record is kept.
    """
    j = main.select(key, "state", F.col("date").alias("_m"), F.lit(True).alias("_in")).join(other.select(key, F.col("date").alias("_d")), key, "full_outer").join(decisions, key, "left")
    mine = F.coalesce("_in", F.lit(False))
    return j.select(key, "state", F.coalesce("_m", "_d").alias("date"), F.when(mine, F.coalesce("keep", F.lit(True))).otherwise(True).alias("keep"), F.when(mine, F.coalesce("stage", F.lit("none"))).otherwise("none").alias("stage"))


def metric_of(vector: Column, name: str) -> Column:
    """A metric's value in a severity vector, the last if it comes twice; empty if it is missing."""
    return F.regexp_extract(F.regexp_replace(F.upper(F.trim(vector)), " ", ""), f"^(?:.*/)?{name}:([A-Z]+)(?:/|$)", 1)


def vector_fields(pred: Column, target: Column) -> dict[str, Column]:
    """Whether each metric, all of them, and the whole vectors agree; a missing metric agrees with nothing."""
    same = {m: F.coalesce((metric_of(pred, m) == metric_of(target, m)) & (metric_of(pred, m) != ""), F.lit(False)) for m in METRICS}
    whole = F.coalesce(F.replace(F.upper(F.trim(pred)), F.lit(" "), F.lit("")) == F.replace(F.upper(F.trim(target)), F.lit(" "), F.lit("")), F.lit(False))
    return same | {"all_fields": reduce(lambda a, b: a & b, same.values()), "vector": whole}


def digest_problem(kind: Column, digest: Column, found: Column) -> Column:
    """What is wrong with a manifest entry; ``found`` is the digest of the bytes that are there."""
    return first_reason([
        ("directory_with_digest", (kind == "dir") & digest.isNotNull()),
        ("no_digest", (kind == "file") & digest.isNull()),
        ("malformed_digest", (kind == "file") & ~digest.rlike("^[0-9a-f]{64}$")),
        ("other_bytes", (kind == "file") & (digest != found)),
    ])


def copyleft(name: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.upper(name).contains(m) for m in COPYLEFT))


def first_writer(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """The value that the first task in order wrote for a key; later ones change nothing."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def partner(key: Column) -> Column:
    """The entity of an example's key, without its task suffix."""
    return F.regexp_replace(key, ":[^:]*$", "")


def discordance(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Percentage of pairs that two flags judge differently, one row."""
    return df.agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count("*").alias("n")).withColumn("percent", F.try_divide(100 * (F.col("only_a") + F.col("only_b")), F.col("n")))
