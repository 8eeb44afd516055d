"""Registry of queries: one per operator, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitehex.plans.oracle import compose

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from sitehex.plans import (  # noqa: F401
        queries_inputs,
        queries_market,
        queries_quality,
        queries_saved,
        queries_streams,
    )
