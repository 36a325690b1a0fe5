"""Registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetstream.plans.oracle import assemble
from fleetstream.plans.pipeline import Pipeline

_QUERIES: dict[str, Callable[[Pipeline], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Pipeline], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} exists")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    from fleetstream.plans import (  # noqa: F401
        q_ingest,
        q_safety,
        q_windows,
        q_incidents,
        q_models,
        q_knowledge,
        q_rollups,
        q_streaming,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf, fn=fn: fn(Pipeline.of(spark, sf))) for n, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: assemble(s) for n, s in _SQL.items()}
