"""All queries of the library, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans.fixtures import Fx, with_fixtures

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("evaluation", "timeline", "projections", "splitting", "resampling", "places", "profiles", "stores", "sinks")


def query(sql: str | None = None):
    """Registers a function of adapters; sql is the same in DuckDB."""

    def add(f: Callable[[Fx], DataFrame]) -> Callable[[Fx], DataFrame]:
        name = f.__name__
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(Fx(spark, sf_dir))
        if sql is not None:
            _SQL[name] = with_fixtures(sql.replace(", 6)", " + 1e-9, 6)"))  # as numeric.r6
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"fieldloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
