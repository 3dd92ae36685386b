"""Where the engine's queries register themselves, each with its equivalent SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register f(spark, sf_dir) under a name; oracle is DuckDB SQL for the same rows, where SQL can express them."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
