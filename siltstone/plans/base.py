"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables whose texts take long to scan.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer partitions than there are cores are spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A small literal table; the same text serves in DuckDB."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def literal_sql(rows: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


#: SQL pieces for DuckDB.
def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def sql_grams(words: str, k: int, least: int | None = None) -> str:
    least = max(k, least or k)
    return f"(CASE WHEN len({words}) >= {least} THEN list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i:i + {k - 1}], ' ')) ELSE [] END)"


def sql_hash(c: str, mod: int) -> str:
    return f"CAST(CAST('0x' || substr(sha256({c}), 1, 16) AS UBIGINT) % {mod} AS BIGINT)"


def sql_canonical(c: str) -> list[str]:
    """Expressions of the canonicalization steps over ``{p}``, the step before."""
    return [
        "nfc_normalize({p})",
        "regexp_replace({p}, '\\r\\n?', chr(10), 'g')",
        "regexp_replace({p}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')",
        "regexp_replace({p}, '[\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{FEFF}\\x{AD}]', '', 'g')",
        "regexp_replace({p}, '[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g')",
        "regexp_replace({p}, '(?m)[ \\t]+$', '', 'g')",
        "regexp_replace({p}, '\\n{3,}', chr(10) || chr(10), 'g')",
        "regexp_replace({p}, '[ \\t]{2,}', ' ', 'g')",
        "trim({p}, ' ' || chr(9) || chr(10))",
    ]


def sql_index(source: str, c: str, cols: str) -> str:
    """A subquery with c0..c9, the texts after each step, and ``cols``."""
    q = f"SELECT {cols}, coalesce({c}, '') AS c0 FROM {source}"
    for i, e in enumerate(sql_canonical(c), 1):
        e = e.replace("{p}", f"c{i - 1}")
        q = f"SELECT *, {e} AS c{i} FROM ({q})"
    return q
