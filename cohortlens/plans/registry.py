"""Registry of named queries: key -> (spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from cohortlens.sources.tables import with_survey

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(key: str, sql: str | None = None, survey_cte: bool = True):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its DuckDB oracle."""
    def deco(fn):
        text = None if sql is None else (with_survey(sql) if survey_cte else sql)
        REGISTRY[key] = (fn, text)
        return fn
    return deco
