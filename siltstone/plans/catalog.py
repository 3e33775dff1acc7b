"""All registered queries and their SQL, by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql
