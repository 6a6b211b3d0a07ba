"""Registry of named queries and their DuckDB oracle SQL.

Plan modules register ``fn(spark, sf_dir) -> DataFrame`` under a key with
``@query(key, oracle_sql)``; ``__spark_entry__`` exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from issuelens.plans import (  # noqa: F401
        analytics_q,
        collect_q,
        consolidate_q,
        events_q,
        features_q,
        learn_q,
        routing_q,
        scoring_q,
        streaming_q,
    )
