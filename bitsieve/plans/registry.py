"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from bitsieve.plans import core_queries, search_queries

MODULES = (core_queries, search_queries)
FLAGSHIP = search_queries.mol_similar_exact


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
