"""Name -> query, and name -> the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plyframe.plans import form_queries, game_queries, metric_queries, prob_queries, sheet_queries, text_queries

_PARTS = [game_queries, prob_queries, text_queries, metric_queries, sheet_queries, form_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
