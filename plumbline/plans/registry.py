"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import estate_queries, graph_queries, lineage_queries, parsing_queries, render_queries, text_queries

MODULES = (graph_queries, text_queries, estate_queries, lineage_queries, parsing_queries, render_queries)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
