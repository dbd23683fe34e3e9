"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftkite.plans.roles import Tables, with_roles

MODULES = ("warehouse", "findings", "scalars", "retrieval", "stateful", "matching", "priorities", "rules", "surfaces", "assessments", "markup")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under `name`, with the SQL that gives its rows."""

    def add(function: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_roles(sql.strip())
        return function

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"siftkite.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialized vulnerability summary, of which the exploitable ones first."""
    return queries()["find_exploitable"](spark, sf_dir)
