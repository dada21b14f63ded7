"""The queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import validate
from strata.plans import graph_queries, structure_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course outlines to graphs, and how often each constraint is violated."""
    return validate.violations(*graph_queries.compiled(spark, sf_dir)).groupBy("graph_id", "type").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return structure_queries.QUERIES | graph_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return structure_queries.ORACLES | graph_queries.ORACLES
