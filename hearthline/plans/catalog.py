"""Registry of named queries: a Spark callable and, where SQL can say it, an independent twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL twin unless it is checked another way."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from hearthline.plans.queries import cleaning, evaluation, features, modelling, pages, profiling, records, statistics, streams, texts  # noqa: F401

    return QUERIES, ORACLES
