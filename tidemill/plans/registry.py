"""All core queries and their SQL equivalents, collected from the modules of this package."""

from __future__ import annotations

from tidemill.plans import general, relational, search

MODULES = [relational, search, general]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
