"""Structural error report and the data behind its figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import evaluate as E

# The counters in report order, their labels, and the differences that three of them count.
COUNTERS = ["missing_titles", "extra_titles", "wrong_node_kinds", "missing_contains_edges", "extra_contains_edges", "missing_sequence_edges", "extra_sequence_edges", "page_grounding_errors"]
LABELS = {
    "missing_titles": "missing titles",
    "extra_titles": "extra titles",
    "wrong_node_kinds": "wrong node kinds",
    "missing_contains_edges": "missing contains edges",
    "extra_contains_edges": "extra contains edges",
    "missing_sequence_edges": "missing sequence edges",
    "extra_sequence_edges": "extra sequence edges",
    "page_grounding_errors": "page-grounding errors",
}


def _counter(difference):
    return F.when(F.endswith(difference, F.lit("titles")), difference).otherwise(F.concat(difference, F.lit("_edges")))


def wrong_kinds(gold: E.Canonical, pred: E.Canonical) -> DataFrame:
    """(graph_id, title, gold, pred): shared titles whose first-seen kinds differ."""
    g, p = gold.first_kind.withColumnRenamed("kind", "gold"), pred.first_kind.withColumnRenamed("kind", "pred")
    return g.join(p, ["graph_id", "title"]).filter("gold <> pred")


def page_errors(gold: E.Canonical, pred: E.Canonical) -> DataFrame:
    """(graph_id, title, gold_pages, pred_pages): shared titles with gold pages whose sets of pages differ."""
    g, p = gold.pages.filter("size(pages) > 0").withColumnRenamed("pages", "g"), pred.pages.withColumnRenamed("pages", "p")
    differ = (F.size(F.array_except("g", "p")) > 0) | (F.size(F.array_except("p", "g")) > 0)
    return g.join(p, ["graph_id", "title"]).filter(differ).select("graph_id", "title", F.array_sort("g").alias("gold_pages"), F.array_sort("p").alias("pred_pages"))


def counters(gold: E.Canonical, pred: E.Canonical, graphs: DataFrame) -> DataFrame:
    """(graph_id and the eight counters) for every graph of ``graphs``."""
    each = (
        E.differences(gold, pred)
        .select("graph_id", _counter(F.col("difference")).alias("error"))
        .unionByName(wrong_kinds(gold, pred).select("graph_id", F.lit("wrong_node_kinds").alias("error")))
        .unionByName(page_errors(gold, pred).select("graph_id", F.lit("page_grounding_errors").alias("error")))
    )
    n = each.groupBy("graph_id").agg(*[F.count_if(F.col("error") == c).alias(c) for c in COUNTERS])
    return graphs.select("graph_id").distinct().join(n, "graph_id", "left").select("graph_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def report(gold: E.Canonical, pred: E.Canonical, documents: DataFrame) -> DataFrame:
    """(graph_id, json) of each of ``documents`` (graph_id, document, gold_path, pred_path): counts and the lists that they count, in order."""
    d = E.differences(gold, pred).withColumn("counter", _counter(F.col("difference")))
    names = [c for c in COUNTERS if c not in ("wrong_node_kinds", "page_grounding_errors")]
    value = lambda c: F.col("a") if c.endswith("titles") else F.struct(F.col("a").alias("source"), F.col("b").alias("target"))
    lists = d.groupBy("graph_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("counter") == c, value(c)))).alias(c) for c in names])
    of = lambda rows, columns, name: rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    kinds = of(wrong_kinds(gold, pred), ["title", F.col("gold").alias("gold_kind"), F.col("pred").alias("pred_kind")], "wrong_node_kinds")
    pages = of(page_errors(gold, pred), ["title", "gold_pages", "pred_pages"], "page_grounding_errors")
    out = documents.join(lists, "graph_id", "left").join(kinds, "graph_id", "left").join(pages, "graph_id", "left")
    full = {c: F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType)) for c in COUNTERS}
    counts, details = (F.struct(*[f(full[c]).alias(c) for c in COUNTERS]) for f in (F.size, lambda x: x))
    return out.select("graph_id", F.to_json(F.struct("document", "gold_path", "pred_path", counts.alias("counts"), details.alias("details")), {"ignoreNullFields": "false"}).alias("json"))


def heatmap(wide: DataFrame) -> DataFrame:
    """(graph_id, counter, n): the matrix of documents and counters, long."""
    return wide.select("graph_id", F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in COUNTERS])).alias("x")).select("graph_id", "x.*")


# Figure -----------------------------------------------------------------------------------------


def figure_differences(differences: DataFrame) -> DataFrame:
    """Differences with both texts normalised as the figure does it."""
    return differences.withColumns({"a": T.figure_norm("a"), "b": T.figure_norm("b")})


def figure_summary(differences: DataFrame, kinds: DataFrame) -> DataFrame:
    """(graph_id, error, n): seven counts from differences() and kind_agreement()."""
    wrong = kinds.filter("NOT match").select("graph_id", F.lit("wrong_kinds").alias("error"))
    return differences.select("graph_id", F.col("difference").alias("error")).unionByName(wrong).groupBy("graph_id", "error").agg(F.count("*").alias("n"))


def wrong_kind_map(kinds: DataFrame) -> DataFrame:
    """(graph_id, title, gold, pred) of titles whose kinds don't overlap, kinds joined by ', '."""
    return kinds.filter("NOT match").select("graph_id", T.figure_norm("title").alias("title"), F.array_join("gold_kinds", ", ").alias("gold"), F.array_join("pred_kinds", ", ").alias("pred"))


def focus_children(differences: DataFrame, parents: list[str]) -> DataFrame:
    """(graph_id, child, missing, extra): children under any of ``parents`` in missing or extra containment, once each."""
    d = differences.filter(F.col("difference").isin("missing_contains", "extra_contains") & F.col("a").isin(parents))
    flag = lambda k: F.bool_or(F.col("difference") == k)
    return d.groupBy("graph_id", F.col("b").alias("child")).agg(flag("missing_contains").alias("missing"), flag("extra_contains").alias("extra"))


def attachment_edges(differences: DataFrame, gold_parent: str, wrong_parent: str) -> DataFrame:
    """(graph_id, child, missing, extra, extra_elsewhere): children that lack the edge from the gold parent, have one too many from it, or from the wrong parent."""
    kind, parent = F.col("difference"), F.col("a")
    at = {"missing": (kind == "missing_contains") & (parent == gold_parent), "extra": (kind == "extra_contains") & (parent == gold_parent), "extra_elsewhere": (kind == "extra_contains") & (parent == wrong_parent)}
    flags = differences.groupBy("graph_id", F.col("b").alias("child")).agg(*[F.bool_or(c).alias(k) for k, c in at.items()])
    return flags.filter("missing OR extra OR extra_elsewhere")


def node_styles(titles: DataFrame, differences: DataFrame, wrong: DataFrame) -> DataFrame:
    """(graph_id, title, style, label): missing before extra before wrong kind before matched."""
    side = lambda k, name: differences.filter(F.col("difference") == k).select("graph_id", F.col("a").alias("title"), F.lit(True).alias(name)).distinct()
    t = titles.join(side("missing_titles", "missing"), ["graph_id", "title"], "left").join(side("extra_titles", "extra"), ["graph_id", "title"], "left").join(wrong, ["graph_id", "title"], "left")
    style = F.when(F.col("missing"), "missing").when(F.col("extra"), "extra").when(F.col("gold").isNotNull(), "wrong_kind").otherwise("matched")
    label = F.concat(T.wrap_label("title"), F.when(F.col("gold").isNotNull(), F.concat(F.lit("\nkind: "), "gold", F.lit(" → "), "pred")).otherwise(""))
    return t.select("graph_id", "title", style.alias("style"), label.alias("label"))
