"""Named queries over the driver tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featurelens.session import adapt

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs for comparison."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf: function(adapt(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from featurelens.plans import (  # noqa: F401
        audit_queries,
        feature_queries,
        image_queries,
        inventory_queries,
        paired_queries,
        probe_queries,
        storage_queries,
        stream_queries,
    )
