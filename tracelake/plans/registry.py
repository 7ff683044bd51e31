"""All registered queries of the core, by name."""

from __future__ import annotations

from tracelake.plans import case_queries, code_queries, graph_queries, records, table_queries

MODULES = (graph_queries, table_queries, code_queries, case_queries, records)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
