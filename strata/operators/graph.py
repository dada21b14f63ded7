"""Typed containment and sequence graphs from outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import outline as O


def nodes(outline: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Graph nodes of normalised outlines, the course (empty ord) included, with the columns in ``keep``.

    (graph_id, ord, id, label, kind, title, number, role, page_start, page_end, evidence_pages, path);
    ord gives the order of the nodes. A course's id covers its title only, any other the path, number and pages.
    """
    o = O.with_path(O.leaves(outline.repartition("doc_id")))
    course = F.size("ord") == 0
    page = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, "").otherwise(F.col(c).cast("string"))
    kind = F.when(course, "COURSE").otherwise(T.section_kind(F.col("leaf"), F.size("ord")))
    number = F.when(~course, T.clean_text("number"))
    key = F.concat_ws("||", F.transform("path", lambda x: T.clean_text(x)), T.clean_text("number"), page("start_page"), page("end_page"))
    digest = F.sha1(F.when(course, T.clean_text("title")).otherwise(key))
    return o.select(
        F.col("doc_id").alias("graph_id"),
        "ord",
        F.concat(kind, F.lit("_"), F.substring(digest, 1, 12)).alias("id"),
        F.col("title").alias("label"),
        kind.alias("kind"),
        "title",
        number.alias("number"),
        F.when(~course, T.clean_text("role")).alias("role"),
        F.col("start_page").alias("page_start"),
        F.col("end_page").alias("page_end"),
        T.page_list(F.col("start_page"), F.col("end_page")).alias("evidence_pages"),
        "path",
        *keep,
    )


def contains(n: DataFrame) -> DataFrame:
    """(graph_id, at, source, target, type) from each parent to its children; ``at`` orders a graph's edges."""
    p = n.select(F.col("graph_id").alias("pg"), F.col("ord").alias("po"), F.col("id").alias("source"))
    c = n.filter(F.size("ord") > 0).select("graph_id", "ord", F.col("id").alias("target"), O.parent().alias("up"))
    return c.join(p, (F.col("graph_id") == F.col("pg")) & (F.col("up") == F.col("po"))).select("graph_id", F.col("ord").alias("at"), "source", "target", F.lit("contains").alias("type"))


def sequence(n: DataFrame) -> DataFrame:
    """As contains(), between consecutive siblings; after all edges below their parent."""
    w = Window.partitionBy("graph_id", "up").orderBy("ord")
    s = n.filter(F.size("ord") > 0).select("graph_id", "ord", "id", O.parent().alias("up")).withColumn("target", F.lead("id").over(w))
    at = F.concat("up", F.array(F.lit(2**31 - 1), F.element_at("ord", -1)))
    return s.filter("target IS NOT NULL").select("graph_id", at.alias("at"), F.col("id").alias("source"), "target", F.lit("sequence").alias("type"))


def edges(n: DataFrame) -> DataFrame:
    return contains(n).unionByName(sequence(n))


def positioned(frame: DataFrame, order: str, by: str = "graph_id") -> DataFrame:
    """``frame`` with ``pos`` from 0 in the order of a graph's rows."""
    return frame.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long") - 1)


def envelope(n: DataFrame, e: DataFrame, violations: DataFrame, outline: DataFrame) -> DataFrame:
    """(graph_id, course_title, node_count, edge_count, validation_ok, violation_count)."""
    title = outline.filter(F.size("ord") == 0).select(F.col("doc_id").alias("graph_id"), F.col("title").alias("course_title"))
    count = lambda f, name: f.groupBy("graph_id").agg(F.count("*").alias(name))
    joined = title.join(count(n, "node_count"), "graph_id", "left").join(count(e, "edge_count"), "graph_id", "left").join(count(violations, "violation_count"), "graph_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("graph_id", "course_title", z("node_count"), z("edge_count"), (F.coalesce("violation_count", F.lit(0)) == 0).alias("validation_ok"), z("violation_count"))
