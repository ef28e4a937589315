"""The registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import bom_queries, list_queries, plant_queries, text_queries, text_search_queries

FLAGSHIP = "d2_compare_revision"
_MODULES = (list_queries, text_queries, bom_queries, text_search_queries, plant_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
