"""Registered queries of the core engine and their DuckDB SQL."""

from __future__ import annotations

from packloom.plans import forward_queries as _forward_queries  # noqa: F401  registers itself
from packloom.plans import model_queries as _model_queries  # noqa: F401  registers itself
from packloom.plans import queries as _queries  # noqa: F401  registers itself
from packloom.plans import source_queries as _source_queries  # noqa: F401  registers itself
from packloom.plans import registry


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
