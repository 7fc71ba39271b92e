"""All queries of the engine by name, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from docweave.queries import chunk_queries, graph_queries, layout_queries, retrieval_queries, value_queries  # noqa: F401


def flagship(spark, sf_dir: str):
    _load()
    return QUERIES["furniture_stripped_docs"](spark, sf_dir)


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
