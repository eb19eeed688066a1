"""Registered queries over the shared tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from . import search_queries, state_queries, store_queries, text_queries, upkeep_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
