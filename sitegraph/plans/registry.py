"""Registry of query keys: Spark plan builders and their DuckDB oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# --- fixed query parameters (crawler knobs used by the registered queries) ---
WEIGHTS = ["/the", "/and", "blog."]
EXCLUDED = ["cheap-pills", "spam-farm", "/to"]
BATCH = 50
# --- end of fixed query parameters ---

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with an optional oracle text."""
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco
