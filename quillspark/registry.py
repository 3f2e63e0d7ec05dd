"""Registered queries: each is a function (spark, sf_dir) -> DataFrame with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules whose import registers their queries.
MODULES: tuple[str, ...] = ("quillspark.plans.core", "quillspark.plans.text", "quillspark.plans.search", "quillspark.plans.lifecycle", "quillspark.plans.more", "quillspark.plans.indexes", "quillspark.plans.governed", "quillspark.plans.traced", "quillspark.plans.facts")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; sql is the same query for DuckDB (None where SQL can't express it)."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
