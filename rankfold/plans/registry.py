"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankfold.plans import analytics, retrieval, runs, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**analytics.QUERIES, **retrieval.QUERIES, **runs.QUERIES, **store.QUERIES}
SQL: dict[str, str] = {**analytics.SQL, **retrieval.SQL, **runs.SQL, **store.SQL}
