"""Summaries of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.validate import KINDS


def by_edge_type(edges: DataFrame) -> DataFrame:
    """(graph_id, type, n); an edge without type is 'unknown'."""
    return edges.groupBy("graph_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def max_path_length(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.coalesce(F.max(F.size("path")), F.lit(0)).cast("long").alias("max_path_length"))


def by_kind(nodes: DataFrame) -> DataFrame:
    """(graph_id, kind, n, min_depth, max_depth, depth_sum, depth_avg) with a row for each of the four kinds."""
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    every = nodes.select("graph_id").distinct().join(F.broadcast(kinds))
    depth = F.when(F.size("path") > 0, F.size("path")).cast("long")
    got = nodes.groupBy("graph_id", "kind").agg(F.count("*").alias("n"), F.min(depth).alias("lo"), F.max(depth).alias("hi"), F.sum(depth).alias("s"), F.count(depth).alias("c"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return every.join(got, ["graph_id", "kind"], "left").select("graph_id", "kind", z("n").alias("n"), z("lo").alias("min_depth"), z("hi").alias("max_depth"), z("s").alias("depth_sum"), F.coalesce(F.try_divide(F.col("s").cast("double"), F.col("c").cast("double")), F.lit(0.0)).alias("depth_avg"))


def kc_grounding(nodes: DataFrame) -> DataFrame:
    """(graph_id, grounded, total, percent) of the KC nodes."""
    kc = F.col("kind") == "KC"
    grounded = kc & ((F.coalesce(F.size("evidence_pages"), F.lit(0)) > 0) | F.col("page_start").isNotNull() | F.col("page_end").isNotNull())
    g = nodes.groupBy("graph_id").agg(F.count_if(grounded).alias("grounded"), F.count_if(kc).alias("total"))
    return g.withColumn("percent", F.coalesce(F.try_divide(F.col("grounded").cast("double"), F.col("total").cast("double")) * 100, F.lit(0.0)))


def overview(nodes: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """(graph_id, node_count, edge_count, course, module, unit, kc, top_sections, validation_ok, violation_count)."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in KINDS], F.count_if(F.size("path") == 2).alias("top_sections"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"))
    v = violations.groupBy("graph_id").agg(F.count("*").alias("violation_count"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "graph_id", "left").join(v, "graph_id", "left").select("graph_id", "node_count", z("edge_count"), *[k.lower() for k in KINDS], "top_sections", F.col("violation_count").isNull().alias("validation_ok"), z("violation_count"))
