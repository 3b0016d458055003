"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.plans import cube_queries, extra_queries, history_queries, model_queries, stream_queries, text_queries

MODULES = [text_queries, cube_queries, model_queries, history_queries, extra_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.O.items()}
