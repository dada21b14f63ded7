"""From outline files to graph files: normalise, build, validate, summarise, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph as G
from strata.operators import outline as O
from strata.operators import summary as B
from strata.operators import validate as V
from strata.sources import readers, sinks
from strata.staging import staged


@dataclass
class Compiled:
    """What a set of outlines becomes; graph_id is the outline's doc_id."""

    outline: DataFrame
    nodes: DataFrame
    edges: DataFrame
    violations: DataFrame
    envelope: DataFrame


def compile_outlines(outlines: DataFrame, passes: int = 1) -> Compiled:
    """Graphs of outlines (doc_id, json), each normalised, compiled and checked."""
    o = O.flatten_outlines(outlines)
    o = o.withColumns({c: F.col(c).cast("int") for c in ("start_page", "end_page")})
    o = staged(O.normalize(o, passes), "outline")
    n = staged(G.positioned(G.nodes(o), "ord"), "nodes")
    e = staged(G.positioned(G.edges(n), "at"), "edges")
    v = staged(V.violations(n, e), "violations")
    return Compiled(o, n, e, v, G.envelope(n, e, v, o))


def summaries(c: Compiled) -> DataFrame:
    """(graph_id, json): counts, depths and grounding of each graph."""
    kinds = B.by_kind(c.nodes).withColumn("avg", T.py_round(F.col("depth_avg"), F.lit(2)))
    of = lambda k, *columns: F.max(F.when(F.col("kind") == k, F.struct(*columns) if len(columns) > 1 else columns[0])).alias(k)
    counts = kinds.groupBy("graph_id").agg(*[of(k, F.col("n")) for k in V.KINDS]).select("graph_id", F.struct(*V.KINDS).alias("counts_by_kind"))
    depths = kinds.groupBy("graph_id").agg(*[of(k, F.col("min_depth").alias("min"), F.col("max_depth").alias("max"), "avg") for k in V.KINDS]).select("graph_id", F.struct(*V.KINDS).alias("depth_by_kind"))
    edges = B.by_edge_type(c.edges).groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts_by_edge_type"))
    ground = B.kc_grounding(c.nodes).select("graph_id", F.struct(F.col("grounded").alias("grounded_kcs"), F.col("total").alias("total_kcs"), T.py_round(F.col("percent"), F.lit(2)).alias("percent")).alias("kc_grounding_coverage"))
    top = c.outline.groupBy(F.col("doc_id").alias("graph_id")).agg(F.count_if(F.size("ord") == 1).alias("outline_top_sections"))
    out = c.envelope
    for part in (top, counts, depths, edges, ground, B.max_path_length(c.nodes)):
        out = out.join(part, "graph_id", "left")
    typed = F.coalesce("counts_by_edge_type", F.from_json(F.lit("{}"), "map<string,bigint>")).alias("counts_by_edge_type")
    depth = F.struct("max_path_length", "depth_by_kind").alias("hierarchy_depth")
    return out.select("graph_id", F.to_json(F.struct("outline_top_sections", "node_count", "edge_count", "counts_by_kind", typed, depth, "kc_grounding_coverage", "validation_ok", "violation_count")).alias("json"))


def export(c: Compiled, path: str) -> None:
    """Below ``path`` a folder for each kind of file, and in it one for each graph: ecg, validation, summary, dot, nodes, edges."""
    whole = sinks.graph_json(c.nodes, c.edges, c.violations, c.envelope)
    text = lambda rows: rows.select("graph_id", F.col("json").alias("text"))
    sinks.write_text(text(whole), f"{path}/ecg")
    sinks.write_text(whole.select("graph_id", F.get_json_object("json", "$.validation").alias("text")), f"{path}/validation")
    sinks.write_text(text(summaries(c)), f"{path}/summary")
    sinks.write_text(sinks.joined_lines(sinks.dot_lines(c.nodes, c.edges)), f"{path}/dot")
    sinks.write_csv(sinks.node_csv(c.nodes), f"{path}/nodes")
    sinks.write_csv(sinks.edge_csv(c.edges), f"{path}/edges")


def build(spark: SparkSession, outlines: str, path: str) -> Compiled:
    """Compile all outline files under ``outlines`` and export them under ``path``."""
    c = compile_outlines(readers.json_documents(spark, outlines))
    export(c, path)
    return c
