"""How a named query is registered with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archloom.sources.projection import CTES, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, graph: bool = True):
    """Register a function of a World; graph: its SQL follows the projection's common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (CTES + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else sql)) if graph else sql
        return f

    return register
