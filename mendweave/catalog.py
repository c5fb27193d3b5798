"""All queries of the package outside ``llm``, with their oracle SQL.

A module of ``mendweave.plans`` registers its queries with ``query``; ``queries`` and ``oracle_sql`` import them all.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

PLANS: tuple[str, ...] = ("urls", "html", "texts", "snapshots", "neighbors", "patterns", "ledgers", "graphs", "relational", "finder", "aliases", "links", "redirects", "evidence", "crawl", "runs")

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLE[name] = oracle
        return f

    return add


def _load() -> None:
    for name in PLANS:
        import_module(f"mendweave.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
