"""Secrets and personal data: findings, counts and redaction.  Values are never shown, only counted or hashed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: type, category, pattern.  Public addresses, domains and hashes are no findings.
TYPES = [
    ("credentials_in_url", "secret", r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@"),
    ("aws_access_key_id", "secret", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", "secret", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", "secret", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("google_api_key", "secret", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("private_key_block", "secret", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("jwt", "secret", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("generic_secret_assignment", "secret", r"""(?i)\b(?:password|passwd|secret|token|api_?key)\b\s*[:=]\s*["'][^"'\s]{8,}["']"""),
    ("email", "pii", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    ("internal_hostname", "pii", r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:local|internal|corp|lan)\b"),
    ("private_ip", "pii", r"\b(?:10\.[0-9]{1,3}|127\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}\b"),
]
#: What stands for a finding.
PSEUDONYM = {"email": "USER_", "internal_hostname": "HOST_", "private_ip": "IP_"}
MARKER = "[REDACTED_SECRET]"


#: What a text holds in any case for a pattern to match; patterns that aren't here have no such literal.
HOLDS = {
    "credentials_in_url": ["://"], "aws_access_key_id": ["AKIA", "ASIA"], "github_token": ["gh"], "slack_token": ["xox"], "google_api_key": ["AIza"],
    "private_key_block": ["-----BEGIN"], "jwt": ["eyJ"], "email": ["@"], "internal_hostname": [".local", ".internal", ".corp", ".lan"],
    "private_ip": ["10.", "127.", "192.168.", "172."],
}


def _matches(t: str, p: str, text: Column) -> Column:
    """All matches; texts without a literal that every match holds aren't scanned."""
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    if t not in HOLDS:
        return found
    return F.when(reduce(lambda a, b: a | b, (text.contains(x) for x in HOLDS[t])), found).otherwise(F.array().cast("array<string>"))


def findings(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row for each finding: key, type, category and value (for counting only)."""
    found = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(c).alias("category"), _matches(t, p, F.coalesce(F.col(text), F.lit(""))).alias("values")) for t, c, p in TYPES))
    return df.select(*key, F.explode(found).alias("f")).select(*key, "f.type", "f.category", F.explode("f.values").alias("value"))


def counts(found: DataFrame, by: list[str]) -> DataFrame:
    """Findings, distinct values and records with findings; distinct values are told apart by hash."""
    return found.groupBy(*by).agg(F.count("*").alias("findings"), F.count_distinct(F.sha2("value", 256)).alias("unique_values"))


def _pseudonyms(c: Column, pattern: str, prefix: str) -> Column:
    """Each match becomes its prefix and four hex digits of its hash: equal values get equal names."""
    named = lambda v: F.concat(F.lit(prefix), F.substring(F.sha2(v, 256), 1, 4))

    def whole(x: Column) -> Column:
        parts, hits = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        tail = F.zip_with(F.transform(hits, named), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda n, p: F.concat(F.coalesce(n, F.lit("")), F.coalesce(p, F.lit(""))))
        return F.when(x.rlike(pattern), F.concat(parts[0], F.array_join(tail, ""))).otherwise(x)

    return T.let(c, whole)


def redact(c: Column) -> Column:
    """Secrets become a marker that can't be undone, personal data stable pseudonyms."""
    c = reduce(lambda x, t: F.regexp_replace(x, t[2], MARKER.replace("$", "\\$")) if t[1] == "secret" else x, TYPES, c)
    return reduce(lambda x, t: _pseudonyms(x, t[2], PSEUDONYM[t[0]]) if t[1] == "pii" else x, TYPES, c)
