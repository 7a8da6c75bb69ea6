"""Query registry over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import function_queries, graph_queries, item_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.query_scheme_predicate_sort(spark, sf_dir)
