"""Registry of the named queries (one per SURVEY key).

Each entry holds the Spark callable ``(spark, sf_dir) -> DataFrame`` built
from library operators, and, where SQL can express it, an independent
DuckDB oracle text over the same adapter views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from ledgerloom.plans import (billing_queries, client_queries, ledger_queries,  # noqa: F401
                                  request_queries, source_queries, stream_queries)
    return REGISTRY
