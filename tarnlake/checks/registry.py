"""Where the queries of all modules are gathered."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tarnlake.session import Lake

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["files", "rows", "relational", "scores", "cleaning", "values", "texts", "lake", "streams"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def check(key: str, sql: str | None = None):
    """Register a function ``Lake → DataFrame`` under ``key`` with its SQL twin."""

    def register(function: Callable[[Lake], DataFrame]):
        if key in _queries:
            raise ValueError(f"{key} is registered twice")

        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Lake(spark, folder))

        _queries[key] = run
        if sql is not None:
            _sql[key] = sql
        return function

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tarnlake.checks.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
