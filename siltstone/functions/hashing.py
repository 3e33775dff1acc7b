"""Stable hashes and order-independent digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_int(c: Column, mod: int) -> Column:
    """The first 64 bits of the text's SHA-256, modulo ``mod``."""
    head = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(mod).cast("decimal(20,0)")).cast("long")


def records_digest(hex_hash: Column) -> Column:
    """Aggregate: SHA-256 over all hashes in ascending order; the rows' order doesn't matter."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hex_hash)), ""), 256)


def id_set_digest(ids: Column) -> Column:
    """Aggregate: SHA-256 over the distinct ids in ascending order, a line each."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256)


def paths_digest(path: Column, digest: Column) -> Column:
    """Aggregate: SHA-256 over "path digest" lines in order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", path, digest))), "\n"), 256)


@F.pandas_udf(StringType())
def canonical_json_sha(raw: pd.Series) -> pd.Series:
    """SHA-256 of JSON text in canonical form: sorted keys, no blanks, UTF-8."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return raw.map(one)


def template_of(key: Column, templates: list[str], text: Column) -> Column:
    """A template picked by the key's stable hash, with ``{input}`` replaced and doubled braces undone."""
    t = F.element_at(F.array(*map(F.lit, templates)), (stable_int(F.concat(F.lit("tpl:"), key), len(templates)) + 1).cast("int"))
    t = F.replace(F.replace(t, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    t = F.replace(F.replace(t, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
    return F.replace(t, F.lit("{input}"), text)
