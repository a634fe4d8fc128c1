"""Registered queries of the candle and message operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import candle_queries, job_queries, message_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = candle_queries.QUERIES | job_queries.QUERIES | message_queries.QUERIES
SQL: dict[str, str] = candle_queries.SQL | job_queries.SQL | message_queries.SQL
