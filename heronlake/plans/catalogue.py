"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_composed, queries_evaluation, queries_feedback, queries_judging, queries_more, queries_retrieval, queries_scoring, queries_text
from .registry import REGISTRY, SQL

_MODULES = (queries_text, queries_retrieval, queries_evaluation, queries_feedback, queries_scoring, queries_more, queries_composed, queries_judging)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
