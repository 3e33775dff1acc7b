"""Two-source entities, their conflicts, label resolution and table building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weakness labels that carry no information.
PLACEHOLDERS = ["NVD-CWE-noinfo", "NVD-CWE-Other"]


def last_per_entity(df: DataFrame, entity: str, ordinal: str) -> DataFrame:
    """The last record of each entity; null entities are skipped."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max_by(F.struct(*[c for c in df.columns if c != entity]), ordinal).alias("_r")).select(entity, "_r.*")


def paired(left: DataFrame, right: DataFrame, entity: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two sources: entity, sources, record_ids, ``left`` and ``right`` structs."""
    pack = lambda d, n: d.select(entity, F.struct(*[c for c in d.columns if c != entity]).alias(n))
    j = pack(left, "left").join(pack(right, "right"), entity, "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("left").isNotNull(), names[0]), F.when(F.col("right").isNotNull(), names[1])))
    ids = F.array_sort(F.array_compact(F.array("left.record_id", "right.record_id")))
    return j.withColumn("sources", sources).withColumn("record_ids", ids)


def set_relation(a: Column, b: Column) -> Column:
    """How two sets disagree: disjoint, partial_overlap or present_in_one_source_only; null if they agree."""
    a, b = F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<string>")))), F.array_sort(F.array_distinct(F.coalesce(b, F.array().cast("array<string>"))))
    na, nb = F.size(a), F.size(b)
    return (
        F.when((na > 0) & (nb > 0) & (a != b), F.when(F.arrays_overlap(a, b), "partial_overlap").otherwise("disjoint"))
        .when((na > 0) != (nb > 0), "present_in_one_source_only")
    )


def score_conflict(a: Column, b: Column, most: float = 0.05) -> Column:
    """True where both scores are there and differ by more than ``most``; one-sided scores are no conflict."""
    return F.coalesce(F.abs(a - b) > most, F.lit(False))


def conflict_counts(df: DataFrame, relation: str, score: str) -> DataFrame:
    """Counters over paired entities, one row."""
    several = F.size("sources") > 1
    return df.agg(
        F.count("*").alias("entities"),
        F.count_if(several).alias("multi_source"),
        F.count_if(~several).alias("single_source"),
        F.count_if(several & F.col(relation).isNotNull()).alias("set_conflicts"),
        F.count_if(several & F.col(score)).alias("score_conflicts"),
        F.count_if(several & (F.col(relation).isNotNull() | F.col(score))).alias("with_conflicts"),
    )


def informative(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: ~x.isin(*PLACEHOLDERS))))


def has_placeholder(ids: Column) -> Column:
    return F.exists(ids, lambda x: x.isin(*PLACEHOLDERS))


def resolve_label(state: Column, first: Column, second: Column, placeholder: Column) -> Column:
    """Struct (bucket, label, source, relation) from two label sets, in order of precedence; bucket names are fixed values."""
    empty = F.array().cast("array<string>")
    a, b = F.array_sort(F.array_distinct(F.coalesce(first, empty))), F.array_sort(F.array_distinct(F.coalesce(second, empty)))
    na, nb = F.size(a), F.size(b)
    none = F.lit(None).cast("string")
    row = lambda bucket, label, source, relation: F.struct(F.lit(bucket).alias("bucket"), label.alias("label"), (F.lit(source) if source else none).alias("source"), (relation if isinstance(relation, Column) else F.lit(relation) if relation else none).alias("relation"))
    one = lambda x: F.try_element_at(x, F.lit(1))
    return (
        F.when(~state.eqNullSafe("PUBLISHED"), row("rejected", none, None, None))
        .when((na > 0) & (nb > 0) & (a == b) & (na == 1), row("agreed", one(a), "agreed", "equal"))
        .when((na > 0) & (nb > 0) & (a == b), row("multi_cwe", none, "agreed", "equal_multi"))
        .when((na > 0) & (nb > 0), row("contested", none, None, F.when(F.arrays_overlap(a, b), "partial_overlap").otherwise("disjoint")))
        .when(na == 1, row("cna", one(a), "cna", "cna_only"))
        .when(na > 1, row("multi_cwe", none, "cna", "cna_only_multi"))
        .when(nb == 1, row("nvd", one(b), "nvd", "nvd_only"))
        .when(nb > 1, row("multi_cwe", none, "nvd", "nvd_only_multi"))
        .when(placeholder, row("placeholder", none, None, "placeholder_only"))
        .otherwise(row("none", none, None, None))
    )


def guard(rows: DataFrame) -> DataFrame:
    """Outcome of re-admitting near-dropped rows (key, cluster, role, stage, label, split).

    A labelled member that near dedup dropped comes back to training if its
    label differs from its representative's and that one is not in evaluation.
    """
    r = rows.where("role = 'representative'").select(F.col("cluster").alias("_c"), F.col("label").alias("rep_label"), F.col("split").alias("rep_split"))
    j = rows.where("stage = 'near' and role = 'member' and label is not null").join(r, F.col("cluster") == F.col("_c"), "left")
    out = (
        F.when(F.col("rep_label").isNull(), "representative_unlabelled")
        .when(F.col("label") == F.col("rep_label"), "same_label")
        .when(F.col("rep_split").startswith("eval"), "representative_in_eval")
        .otherwise("readmitted")
    )
    return j.withColumn("outcome", out).drop("_c")


def exclusions(df: DataFrame, task: str, reason: str) -> DataFrame:
    """Count of rows by task and reason; rows without a reason are not excluded."""
    return df.where(F.col(reason).isNotNull()).groupBy(task, reason).agg(F.count("*").alias("n"))


def extraction_reason(affected: Column, description: Column, most_versions: int = 16) -> Column:
    """Why a record gives no extraction target, first reason that holds; ``affected`` is an array of (vendor, product, versions)."""
    n, one = F.size(affected), F.try_element_at(affected, F.lit(1))
    blank = lambda c: c.isNull() | F.lower(F.trim(c)).isin("", "n/a")
    return (
        F.when(F.coalesce(n, F.lit(0)) < 1, "no_product")
        .when(n > 1, "several_products")
        .when(blank(one["vendor"]) | blank(one["product"]), "vendor_or_product_missing")
        .when(F.coalesce(F.size(one["versions"]), F.lit(0)) < 1, "no_versions")
        .when(F.size(one["versions"]) > most_versions, "too_many_versions")
        .when(F.coalesce(F.trim(description), F.lit("")) == "", "empty_description")
    )


def description(items: Column) -> Column:
    """First non-empty description, English ones before the rest; no language counts as English."""
    english = lambda d: F.coalesce(d["lang"], F.lit("en")).startswith("en")
    ordered = F.concat(F.filter(items, english), F.filter(items, lambda d: ~english(d)))
    return F.coalesce(F.try_element_at(F.filter(ordered, lambda d: F.coalesce(d["value"], F.lit("")) != ""), F.lit(1))["value"], F.lit(""))


def first_present(*scores: Column) -> Column:
    return F.coalesce(*scores)


def technique_id(refs: Column, sources: tuple[str, ...] = ("mitre-attack", "mitre-mobile-attack", "mitre-ics-attack")) -> Column:
    """External id of the first reference of the given sources that has one."""
    return F.try_element_at(F.filter(refs, lambda r: r["source_name"].isin(*sources) & (F.coalesce(r["external_id"], F.lit("")) != "")), F.lit(1))["external_id"]


def technique_table(objects: DataFrame, technique: str = "technique_id", ordinal: str = "ordinal") -> DataFrame:
    """First copy of each technique, without revoked or deprecated ones.  A revoked first copy hides a later live one."""
    t = objects.where(F.col(technique).startswith("T"))
    f = t.groupBy(technique).agg(F.min_by(F.struct(*[c for c in t.columns if c != technique]), ordinal).alias("_r")).select(technique, "_r.*")
    return f.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))


def without_links(c: Column) -> dict[str, Column]:
    """A description without links and citations, and how many of each were taken."""
    link, url, cite = r"\[([^\]]*)\]\(https?://attack\.mitre\.org[^)]*\)", r"https?://attack\.mitre\.org\S*", r"\(Citation: [^)]*\)"
    one = F.regexp_replace(c, link, "$1")
    two = F.regexp_replace(one, url, "")
    return {"clean": F.regexp_replace(two, cite, ""), "links": (F.regexp_count(c, F.lit(link)) + F.regexp_count(one, F.lit(url))).cast("long"), "citations": F.regexp_count(two, F.lit(cite)).cast("long")}
