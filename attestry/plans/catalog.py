"""Query name -> Spark builder and, where SQL can say it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator that adds one query; ``oracle`` is DuckDB SQL with the same column names."""

    def add(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if oracle:
            _ORACLES[name] = oracle
        return build

    return add


def _load() -> None:
    from attestry.plans import claim_queries, detail_queries, entity_queries, fusion_queries, overview_queries, profile_queries, relational_queries, resume_queries, retrieval_queries, review_queries, search_queries, text_queries  # noqa: F401


def queries() -> dict[str, Builder]:
    _load()
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
