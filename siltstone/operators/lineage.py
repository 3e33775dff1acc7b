"""Lineage envelopes: building, validating, and manifests over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a lineage struct, in order.
FIELDS = ["source_id", "source_name", "source_url", "source_pin", "retrieved_at", "record_id", "entity_id", "content_type", "source_license", "upstream_license", "redistribution_status", "commercial_status", "contains_third_party_content", "pii_policy", "model_publication_status", "transform_history", "content_sha256"]
NULLABLE = ["entity_id"]


def make(values: dict[str, Column], license_block: dict[str, Column]) -> Column:
    """The lineage struct of a record: its own values and its source's license block."""
    v = values | license_block
    kinds = {"contains_third_party_content": "boolean", "transform_history": "array<string>"}
    return F.struct(*(v.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS))


def violations(df: DataFrame, allowed: dict[str, list[str]], fields: list[str] = FIELDS) -> Column:
    """Array of problems of a flat lineage row: missing, null, blank, unknown status, malformed digest."""
    out = [F.lit(f"missing:{f}") for f in fields if f not in df.columns]
    out += [F.lit(f"extra:{c}") for c in df.columns if c not in fields]
    for f in (f for f in fields if f in df.columns):
        kind = df.schema[f].dataType.simpleString()
        if f not in NULLABLE:
            out.append(F.when(F.col(f).isNull(), f"null:{f}"))
        if kind == "string":
            out.append(F.when(F.trim(f) == "", f"blank:{f}"))
        if f in allowed:
            out.append(F.when(~F.col(f).isin(*allowed[f]), f"unknown:{f}"))
    if "content_sha256" in df.columns:
        out.append(F.when(~F.col("content_sha256").rlike("^[0-9a-f]{64}$"), "malformed:content_sha256"))
    return F.array_compact(F.array(*out))


def strict(df: DataFrame, problems: str = "violations") -> DataFrame:
    """Fails the query at the first row that has a problem."""
    bad = F.size(problems) > 0
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit("lineage: "), F.array_join(problems, ", ")))).otherwise(F.lit(True)).cast("boolean"))


def manifest(df: DataFrame, by: list[str], entity: str, entityless: Column) -> DataFrame:
    """Counts by group: records, entity present and missing, identifiable, and both coverages."""
    n, have = F.count("*"), F.count(entity)
    able = n - F.count_if(entityless)
    return df.groupBy(*by).agg(
        n.alias("records"), have.alias("entity_present"), (n - have).alias("entity_missing"), able.alias("identifiable"),
        F.try_divide(have, n).alias("coverage"), F.try_divide(have, able).alias("coverage_identifiable"),
    )


def manifest_problems(recorded: DataFrame, found: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """path and problem: missing, unexpected or changed entries."""
    j = recorded.select(path, F.col(digest).alias("_r"), F.lit(True).alias("_in_r")).join(found.select(path, F.col(digest).alias("_f"), F.lit(True).alias("_in_f")), path, "full_outer")
    problem = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_r").isNull(), "unexpected").when(~F.col("_r").eqNullSafe(F.col("_f")), "digest differs")
    return j.withColumn("problem", problem).where("problem is not null").select(path, "problem")


#: What asserts each permission and what denies it.
EVIDENCE = {
    "redistribution": (r"(?i)\b(?:redistribut\w*|copy|copies|share|publish)\b", r"(?i)\b(?:not|no|without|prohibit\w*)\b[^.]{0,40}\b(?:redistribut\w*|share|publish)\b"),
    "commercial": (r"(?i)\bcommercial\b|\bsell\b|\bsublicense\b", r"(?i)\bnon-?commercial\b|\bnot\b[^.]{0,40}\bcommercial\b"),
}


def license_audit(df: DataFrame, text: str, asserted: dict[str, str]) -> DataFrame:
    """Adds a ``<permission>_problem`` for each asserted permission whose text gives no evidence, or denies it."""
    out = df
    for p, col in asserted.items():
        yes, no = EVIDENCE[p]
        out = out.withColumn(f"{p}_problem", F.when(F.col(col) & ~F.col(text).rlike(yes), "no evidence").when(F.col(col) & F.col(text).rlike(no), "denied"))
    return out
