"""Registered queries and the SQL that states each result."""

from __future__ import annotations

from folioforge.queries import compile, identity, knowledge, telemetry, upkeep, wiki

MODULES = (telemetry, knowledge, compile, wiki, identity, upkeep)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
