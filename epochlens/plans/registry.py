"""All registered queries and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epochlens.plans import catalogue_queries, history_queries, index_queries, search_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*history_queries.QUERIES, *search_queries.QUERIES, *catalogue_queries.QUERIES, *index_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return history_queries.SQL | search_queries.SQL | catalogue_queries.SQL | index_queries.SQL
