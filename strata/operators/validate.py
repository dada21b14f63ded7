"""Integrity constraints on graphs: one row (graph_id, type, node_id, parent_id, child_id, source, target) for each violation.

Nodes are (graph_id, pos, id, kind, title, page_start, page_end, evidence_pages, path), edges
(graph_id, pos, source, target, type). The first node of an id stands for it. Containment edges
between known nodes are a bag: repeated ones count.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.staging import staged

# The vocabularies of nodes, edges and legal containment.
KINDS = ["COURSE", "MODULE", "UNIT", "KC"]
EDGE_TYPES = ["contains", "sequence"]
LEGAL = [("COURSE", "MODULE"), ("COURSE", "KC"), ("MODULE", "UNIT"), ("MODULE", "KC"), ("UNIT", "UNIT"), ("UNIT", "KC")]
COLUMNS = ["node_id", "parent_id", "child_id", "source", "target"]


def _as(rows: DataFrame, kind, **columns: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select("graph_id", kind.alias("type"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast("string").alias(c) for c in COLUMNS])


def _checked(rows: DataFrame, checks: dict, **columns: str) -> DataFrame:
    """A violation for each of ``checks`` (type: condition) that holds on a row, in one pass over the rows."""
    hits = F.filter(F.array(*[F.when(condition, F.lit(kind)) for kind, condition in checks.items()]), lambda x: x.isNotNull())
    return _as(rows.withColumn("kind_", F.explode(hits)), F.col("kind_"), **columns)


def first_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each id; rows without an id are not addressable."""
    w = Window.partitionBy("graph_id", "id").orderBy("pos")
    return nodes.filter("id IS NOT NULL AND id <> ''").withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with the columns of their ends as structs s and t, null where the end is unknown."""
    n = first_nodes(nodes)
    end = lambda k: n.select(F.col("graph_id").alias(f"{k}g"), F.col("id").alias(f"{k}i"), F.struct("id", "kind", "title", "page_start", "page_end", "path").alias(k))
    e = edges.select("graph_id", "pos", "source", "target", "type")
    e = e.join(end("s"), (F.col("graph_id") == F.col("sg")) & (F.col("source") == F.col("si")), "left").join(end("t"), (F.col("graph_id") == F.col("tg")) & (F.col("target") == F.col("ti")), "left")
    return e.select("graph_id", "pos", "source", "target", "type", "s", "t")


def has_cycle(edges: list[tuple[str, str]]) -> bool:
    """Whether a directed graph has a cycle: vertices that nothing points at are taken away until none is left."""
    after: dict[str, list[str]] = {}
    degree: dict[str, int] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        degree[b] = degree.get(b, 0) + 1
        degree.setdefault(a, 0)
    free = [v for v, n in degree.items() if n == 0]
    seen = 0
    while free:
        v = free.pop()
        seen += 1
        for w in after.get(v, ()):
            degree[w] -= 1
            if degree[w] == 0:
                free.append(w)
    return seen < len(degree)


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All violations: one pass over the nodes, one over all edges, one over containment and two over sequence edges."""
    e = staged(with_ends(nodes, edges), "edges")  # e, c and the degrees feed several of the passes
    c = e.filter("type = 'contains' AND s IS NOT NULL AND t IS NOT NULL")
    c = c.withColumns({"parents": F.count("*").over(Window.partitionBy("graph_id", "target")), "key": T.normalize_key("t.title")})
    c = c.withColumns({"twin": F.row_number().over(Window.partitionBy("graph_id", "source", "key").orderBy("pos")), "place": F.row_number().over(Window.partitionBy("graph_id", "source").orderBy("pos")) - 1})
    c = staged(c, "containment")
    indegree = c.groupBy(F.col("graph_id").alias("cg"), F.col("target").alias("ci")).agg(F.count("*").alias("parents"), F.min("source").alias("only_parent"), F.min("place").alias("place"))
    indegree = staged(indegree, "indegree")
    outdegree = c.groupBy(F.col("graph_id").alias("og"), F.col("source").alias("oi")).agg(F.count("*").alias("children"))
    n = nodes.join(indegree.drop("place"), (F.col("graph_id") == F.col("cg")) & (F.col("id") == F.col("ci")), "left").join(outdegree, (F.col("graph_id") == F.col("og")) & (F.col("id") == F.col("oi")), "left")
    n = n.withColumns({"parents": F.coalesce("parents", F.lit(0)), "children": F.coalesce("children", F.lit(0)), "clean": T.clean_text("title"), "rank": F.row_number().over(Window.partitionBy("graph_id", "id").orderBy("pos"))})
    kind, course = F.col("kind"), F.coalesce(F.col("kind") == "COURSE", F.lit(False))
    has_id = F.coalesce("id", F.lit("")) != ""
    grounded = (F.coalesce(F.size("evidence_pages"), F.lit(0)) > 0) | F.col("page_start").isNotNull() | F.col("page_end").isNotNull()
    has_path = F.coalesce(F.size("path"), F.lit(0)) > 0
    of_nodes = {
        "duplicate_node_id": has_id & (F.col("rank") > 1),
        "missing_node_id": ~has_id,
        "invalid_node_kind": F.coalesce(~kind.isin(KINDS), F.lit(True)),
        "empty_title": F.col("clean") == "",
        "parent_count": ~course & (F.col("parents") != 1),
        "course_has_parent": course & (F.col("parents") > 0),
        "invalid_page_range": F.col("page_start") > F.col("page_end"),
        "kc_has_children": (kind == "KC") & (F.col("children") > 0),
        "empty_unit": (kind == "UNIT") & (F.col("children") == 0),
        "empty_module": (kind == "MODULE") & (F.col("children") == 0),
        "kc_missing_page_grounding": (kind == "KC") & ~grounded,
        "invalid_path": ~has_path,
        "path_title_mismatch": has_path & (T.clean_text(F.try_element_at("path", F.lit(-1))) != F.col("clean")),
    }
    of_edges = {
        "invalid_edge_type": F.coalesce(~F.col("type").isin(EDGE_TYPES), F.lit(True)),
        "missing_source_node": F.col("s").isNull(),
        "missing_target_node": F.col("t").isNull(),
    }
    legal = reduce(lambda a, b: a | b, [(F.col("s.kind") == a) & (F.col("t.kind") == b) for a, b in LEGAL])
    prefix = F.slice("t.path", F.lit(1), F.greatest(F.size("s.path"), F.lit(0)))
    of_contains = {
        "duplicate_sibling_title": F.col("twin") > 1,
        "child_starts_before_parent": F.col("t.page_start") < F.col("s.page_start"),
        "child_ends_after_parent": F.col("t.page_end") > F.col("s.page_end"),
        "path_parent_prefix_mismatch": (F.col("parents") == 1) & (prefix != F.col("s.path")),
    }
    q = e.filter("type = 'sequence'").withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "source", "target").orderBy("pos")))
    siblings, broken = sequence_siblings(indegree, q)
    siblings = staged(siblings, "siblings")
    graphs = nodes.select("graph_id", (F.col("kind") == "COURSE").alias("root")).unionByName(edges.select("graph_id", F.lit(False).alias("root")))
    roots = graphs.groupBy("graph_id").agg(F.count_if("root").alias("roots")).filter("roots <> 1")
    ends = {"source": "source", "target": "target"}
    return reduce(
        DataFrame.unionByName,
        [
            _checked(n, of_nodes, node_id="id"),
            _as(roots, "course_root_count"),
            _checked(e, of_edges, **ends),
            _checked(c, {"invalid_contains_hierarchy": F.coalesce(~legal, F.lit(True))}, **ends),
            _checked(c, of_contains, parent_id="source", child_id="target"),
            _checked(q, {"sequence_self_loop": F.col("source").eqNullSafe(F.col("target")), "duplicate_sequence_edge": F.col("rank") > 1}, **ends),
            _as(broken, "sequence_not_between_siblings", **ends),
            _as(siblings.filter("ti <> si + 1"), "sequence_not_adjacent", parent_id="parent", **ends),
            _as(sequence_cycles(siblings), "sequence_cycle", parent_id="parent"),
        ],
    )


def sequence_siblings(indegree: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between children of one parent with their places si and ti, the others); edges with an unknown end are in neither."""
    one = lambda k, place: indegree.filter("parents = 1").select(F.col("cg").alias(f"g{k}"), F.col("ci").alias(f"i{k}"), F.col("only_parent").alias(f"p{k}"), F.col("place").alias(place))
    known = q.filter("s IS NOT NULL AND t IS NOT NULL").select("graph_id", "pos", "source", "target")
    both = known.join(one("a", "si"), (F.col("graph_id") == F.col("ga")) & (F.col("source") == F.col("ia")), "left").join(one("b", "ti"), (F.col("graph_id") == F.col("gb")) & (F.col("target") == F.col("ib")), "left")
    same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    return both.filter(same).select("graph_id", F.col("pa").alias("parent"), "pos", "source", "target", "si", "ti"), both.filter(~same).select("graph_id", "source", "target")


def sequence_cycles(siblings: DataFrame) -> DataFrame:
    """(graph_id, parent) whose sequence edges have a cycle. A cycle needs an edge that doesn't ascend, so only such parents are searched."""
    suspect = siblings.filter("ti <= si").select(F.col("graph_id").alias("ug"), F.col("parent").alias("up")).distinct()
    rows = siblings.join(suspect, (F.col("graph_id") == F.col("ug")) & (F.col("parent") == F.col("up")), "left_semi").select("graph_id", "parent", "source", "target")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["graph_id", "parent"]].head(1) if has_cycle(list(zip(pdf["source"], pdf["target"], strict=True))) else pdf[["graph_id", "parent"]].head(0)

    kind = siblings.schema["graph_id"].dataType.simpleString()
    return rows.groupBy("graph_id", "parent").applyInPandas(search, f"graph_id {kind}, parent string")
