"""The registry of queries: a function of the stand-in views and, where SQL can express it, the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.views import Views, duckdb_with

#: Examples on fixed inputs of their own: tests run them, but they read no table and are not registered.
FIXED = frozenset(
    """dr_1_claims wk_12_operations res_11_import_paths sc_1_query_plan sc_2_concepts src_1_corpus_scan src_2_languages src_3_calls_and_imports src_3_parse_errors
    src_4_symbols src_5_ddl src_6_openapi src_7_decisions src_8_routes src_13_markdown_entities snk_1_supersession""".split()
)

_FOUND: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; sql may use the named views."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = (fn, None if sql is None else (duckdb_with(*views) if views else "") + sql.strip())
        return fn

    return add


def _load() -> None:
    from marlstone.plans import (  # noqa: F401
        corpus_queries,
        delta_queries,
        drift_queries,
        graph_queries,
        index_queries,
        knowledge_queries,
        log_queries,
        lookup_queries,
        ranking_queries,
        resolution_queries,
        retrieval_queries,
        scope_queries,
        source_queries,
        structural_queries,
        text_queries,
        vector_queries,
    )


def _bound(fn: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries over the tables."""
    _load()
    return {name: _bound(fn) for name, (fn, _) in _FOUND.items() if name not in FIXED}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None and name not in FIXED}


def examples() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """The examples on fixed inputs, with their SQL, for tests."""
    _load()
    return {name: (_bound(fn), sql) for name, (fn, sql) in _FOUND.items() if name in FIXED}
