"""Scoring a predicted graph against gold, for many pairs at once (key: graph_id).

Canonical relations: titles (graph_id, title), kinds (graph_id, title, kind), edges (graph_id, type,
a, b), pages (graph_id, title, pages). ``profile`` is "eval" (numbers get their dot, hyphens spaces,
kinds by overlap) or "report" (the error report's own rules).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators.validate import first_nodes
from strata.staging import staged


@dataclass
class Canonical:
    titles: DataFrame
    kinds: DataFrame
    edges: DataFrame
    pages: DataFrame
    #: One kind a title: the alphabetically first, or in the report the first seen.
    first_kind: DataFrame


def _title(profile: str, numbered: bool):
    number = F.col("number") if numbered else F.lit(None).cast("string")
    return T.eval_heading_full("title", number) if profile == "eval" else T.report_title("title", number)


def canonical(nodes: DataFrame, edges: DataFrame, pages: DataFrame, profile: str = "eval", include_course: bool = False, numbered: bool = True) -> Canonical:
    """nodes (graph_id, pos, id, kind, title, number), edges (graph_id, source, target, type), pages (graph_id, pos, id, pages)."""
    keep = nodes if include_course or profile == "report" else nodes.filter("kind IS NULL OR kind <> 'COURSE'")
    if profile == "report":
        keep = keep.filter("id IS NOT NULL AND id <> ''")
    named = keep.withColumn("full", _title(profile, numbered)).select("graph_id", "pos", "id", F.trim(F.coalesce("kind", F.lit(""))).alias("kind"), "full")
    named = staged(named, "named")  # feeds all relations
    titled = named.filter("full <> ''")
    kinds = titled.select("graph_id", F.col("full").alias("title"), "kind")
    kinds = (kinds.filter("kind <> ''") if profile == "report" else kinds).distinct()
    first = F.min_by("kind", "pos") if profile == "report" else F.min("kind")
    source = titled.filter("kind <> ''") if profile == "report" else titled
    of = named.groupBy("graph_id", "id").agg(F.max_by("full", "pos").alias("full"))
    end = lambda k: of.select(F.col("graph_id").alias(f"g{k}"), F.col("id").alias(f"i{k}"), F.col("full").alias(k))
    e = edges.filter("type IN ('contains', 'sequence')").join(end("a"), (F.col("graph_id") == F.col("ga")) & (F.col("source") == F.col("ia"))).join(end("b"), (F.col("graph_id") == F.col("gb")) & (F.col("target") == F.col("ib")))
    if profile == "report":
        e = e.filter("a <> '' AND b <> ''")
    p = pages.join(named.select(F.col("graph_id").alias("ng"), F.col("id").alias("ni"), F.col("pos").alias("np"), "full"), (F.col("graph_id") == F.col("ng")) & (F.col("id") == F.col("ni")) & (F.col("pos") == F.col("np")))
    if numbered or profile == "report":
        p = p.filter("full <> ''")
    return Canonical(
        titles=titled.select("graph_id", F.col("full").alias("title")).distinct(),
        kinds=kinds,
        edges=e.select("graph_id", "type", "a", "b").distinct(),
        pages=p.groupBy("graph_id", F.col("full").alias("title")).agg(F.max_by("pages", "pos").alias("pages")),
        first_kind=source.groupBy("graph_id", F.col("full").alias("title")).agg(first.alias("kind")),
    )


def relations(c: Canonical) -> DataFrame:
    """The four relations as (graph_id, relation, a, b)."""
    none = F.lit("")
    return (
        c.titles.select("graph_id", F.lit("titles").alias("relation"), F.col("title").alias("a"), none.alias("b"))
        .unionByName(c.kinds.select("graph_id", F.lit("title_kind").alias("relation"), F.col("title").alias("a"), F.col("kind").alias("b")))
        .unionByName(c.edges.select("graph_id", F.col("type").alias("relation"), "a", "b"))
    )


def compare(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(graph_id, relation, a, b, in_gold, in_pred): one full join of two sets."""
    g, p = gold.withColumn("in_gold", F.lit(True)), pred.withColumn("in_pred", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return g.join(p, ["graph_id", "relation", "a", "b"], "full").select("graph_id", "relation", "a", "b", no("in_gold"), no("in_pred"))


def set_metrics(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, relation, tp, fp, fn, precision, recall, f1, jaccard), not rounded."""
    both = compare(relations(gold), relations(pred))
    m = both.groupBy("graph_id", "relation").agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_pred")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.select("graph_id", "relation", "tp", "fp", "fn", *[c.alias(k) for k, c in T.prf1(tp, fp, fn).items()], T.jaccard(tp, tp + fn, tp + fp).alias("jaccard"))


def _shared_pages(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, title, g, p, tp, fp, fn): the pages of the titles that both ground."""
    g, p = gold.pages.withColumnRenamed("pages", "g"), pred.pages.withColumnRenamed("pages", "p")
    size = lambda c: F.size(c).cast("long")
    return g.join(p, ["graph_id", "title"]).withColumns({"tp": size(F.array_intersect("g", "p")), "fp": size(F.array_except("p", "g")), "fn": size(F.array_except("g", "p"))})


def page_grounding(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, title, tp, fp, fn, grounded) of the titles that both ground."""
    return _shared_pages(gold, pred).select("graph_id", "title", "tp", "fp", "fn", (F.size("p") > 0).alias("grounded"))


def page_grounding_micro(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, tp, fp, fn, precision, recall, f1, grounded_kc_rate): totals; the rate is over all gold titles."""
    m = page_grounding(gold, pred).groupBy("graph_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count_if("grounded").alias("grounded"))
    total = gold.pages.groupBy("graph_id").agg(F.count("*").alias("titles"))
    tp, fp, fn = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp", "fn"))
    return total.join(m, "graph_id", "left").select("graph_id", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *[c.alias(k) for k, c in T.prf1(tp, fp, fn).items()], T.safe_div(F.coalesce("grounded", F.lit(0)), F.col("titles")).alias("grounded_kc_rate"))


def kind_agreement(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, title, gold_kinds, pred_kinds, match) of the shared titles; kinds sorted, a match if they overlap."""
    of = lambda c, name: c.kinds.groupBy("graph_id", "title").agg(F.array_sort(F.collect_set("kind")).alias(name))
    both = of(gold, "gold_kinds").join(of(pred, "pred_kinds"), ["graph_id", "title"])
    return both.withColumn("match", F.arrays_overlap("gold_kinds", "pred_kinds"))


def kind_confusion(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, gold, pred, n) over the alphabetically first kinds."""
    return kind_agreement(gold, pred).groupBy("graph_id", F.col("gold_kinds")[0].alias("gold"), F.col("pred_kinds")[0].alias("pred")).agg(F.count("*").alias("n"))


def kind_accuracy(gold: Canonical, pred: Canonical) -> DataFrame:
    m = kind_agreement(gold, pred).groupBy("graph_id").agg(F.count("*").alias("matched_titles"), F.count_if("match").alias("correct"))
    return m.withColumn("title_kind_accuracy", T.safe_div(F.col("correct"), F.col("matched_titles")))


def differences(gold: Canonical, pred: Canonical) -> DataFrame:
    """(graph_id, difference, a, b): missing_* and extra_* titles, contains and sequence."""
    both = compare(relations(gold), relations(pred)).filter("in_gold <> in_pred AND relation <> 'title_kind'")
    return both.select("graph_id", F.concat(F.when(F.col("in_gold"), "missing_").otherwise("extra_"), "relation").alias("difference"), "a", "b")


def near_matches(gold: Canonical, pred: Canonical, most: int | None = None) -> DataFrame:
    """(graph_id, text_norm, gold_candidates, pred_candidates, count) of unmatched titles that are equal without their numbers.

    ``count`` is how many a graph has; with ``most`` only the first of them by text are listed.
    """
    d = differences(gold, pred).filter("difference IN ('missing_titles', 'extra_titles')").withColumn("text_norm", T.eval_normalize_title(T.leading_number("a")["body"]))
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("difference") == k, F.col("a"))))
    m = d.groupBy("graph_id", "text_norm").agg(side("missing_titles").alias("gold_candidates"), side("extra_titles").alias("pred_candidates")).filter("size(gold_candidates) > 0 AND size(pred_candidates) > 0")
    m = m.withColumn("count", F.count("*").over(Window.partitionBy("graph_id")))
    if most is None:
        return m
    return m.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("text_norm"))).filter(F.col("place") <= most).drop("place")


def carried_validation(graphs: DataFrame) -> DataFrame:
    """(graph_id, validation_ok, violation_count) of prediction JSON (graph_id, json): the metadata stand in for a missing flag, or for violations that are no list."""
    get = lambda path: F.get_json_object("json", path)
    listed = get("$.validation.violations")
    count = F.when(listed.isNull(), 0).when(F.startswith(listed, F.lit("[")), F.json_array_length(listed)).otherwise(F.coalesce(get("$.metadata.violation_count").cast("int"), F.lit(0)))
    return graphs.select("graph_id", F.coalesce(get("$.validation.ok"), get("$.metadata.validation_ok")).cast("boolean").alias("validation_ok"), count.cast("long").alias("violation_count"))


# What the report calls the relations, and how many near matches it lists.
REPORTED = {"titles": "nodes_by_title", "title_kind": "nodes_by_title_and_kind", "contains": "contains", "sequence": "sequence"}
NEAR_EXAMPLES = 50


def report(gold: Canonical, pred: Canonical, validation: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """(graph_id, json): inputs, summary, metrics and details of each pair, ratios rounded as the report shows them.

    ``validation`` is (graph_id, validation_ok, violation_count), ``inputs`` (graph_id, gold, pred, include_course).
    For the sink: lists of a pair are gathered here, in the order of their texts.
    """
    r = lambda c: T.py_round(F.col(c), F.lit(6)).alias(c)
    of = lambda rows, value, name: rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(value)).alias(name))
    rates = ["tp", "fp", "fn", r("precision"), r("recall"), r("f1")]
    zero = F.from_json(F.lit('{"tp":0,"fp":0,"fn":0,"precision":0.0,"recall":0.0,"f1":0.0,"jaccard":1.0}'), "tp long, fp long, fn long, precision double, recall double, f1 double, jaccard double")
    sets = set_metrics(gold, pred).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("relation", F.struct(*rates, r("jaccard"))))).alias("sets"))
    found = lambda k: F.coalesce(F.try_element_at("sets", F.lit(k)), zero)
    micro = page_grounding_micro(gold, pred).select("graph_id", F.struct(*rates, r("grounded_kc_rate")).alias("micro"))
    kinds = kind_accuracy(gold, pred).select("graph_id", F.struct(r("title_kind_accuracy"), "matched_titles").alias("kinds"))
    each = _shared_pages(gold, pred)
    each = each.withColumns(T.prf1(F.col("tp"), F.col("fp"), F.col("fn")))
    pages = of(each, F.struct("title", F.struct(F.array_sort("g").alias("gold_pages"), F.array_sort("p").alias("pred_pages"), *rates).alias("v")), "page_list")
    agreed = of(kind_agreement(gold, pred), F.struct("title", F.struct("gold_kinds", "pred_kinds", "match").alias("v")), "kind_list")
    confusion = of(kind_confusion(gold, pred), F.struct("gold", "pred", F.col("n").alias("count")), "confusion")
    d = differences(gold, pred)
    sides = [f"{side}_{k}" for k in ("titles", "contains", "sequence") for side in ("missing", "extra")]
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("difference") == k, F.col("a") if k.endswith("titles") else F.array("a", "b")))).alias(k)
    lists = d.groupBy("graph_id").agg(*[listed(k) for k in sides]).select("graph_id", F.struct(*sides).alias("differences"))
    near = near_matches(gold, pred, NEAR_EXAMPLES).groupBy("graph_id").agg(F.struct(F.max("count").alias("count"), F.array_sort(F.collect_list(F.struct("text_norm", "gold_candidates", "pred_candidates"))).alias("examples")).alias("near"))
    out = gold.titles.select("graph_id").union(pred.titles.select("graph_id")).distinct()
    for part in (sets, micro, kinds, pages, agreed, confusion, lists, near):
        out = out.join(part, "graph_id", "left")
    if validation is None:
        out = out.withColumn("checked", F.struct(F.lit(None).cast("boolean").alias("ok"), F.lit(0).cast("long").alias("violation_count")))
    else:
        out = out.join(validation.select("graph_id", F.struct(F.col("validation_ok").alias("ok"), "violation_count").alias("checked")), "graph_id", "left")
    if inputs is None:
        out = out.withColumn("inputs", F.lit(None).cast("struct<gold:string,pred:string,include_course:boolean>"))
    else:
        out = out.join(inputs.select("graph_id", F.struct("gold", "pred", "include_course").alias("inputs")), "graph_id", "left")
    or_empty = lambda c: F.coalesce(c, F.from_json(F.lit("{}" if c == "differences" else "[]"), out.schema[c].dataType))
    total = lambda k, side: (found(k)["tp"] + found(k)[side])
    summary = F.struct(*[total(k, side).alias(f"{name}_{what}_count") for k, what in (("titles", "node"), ("contains", "contains"), ("sequence", "sequence")) for name, side in (("gold", "fn"), ("pred", "fp"))])
    nothing = F.from_json(F.lit('{"tp":0,"fp":0,"fn":0,"precision":0.0,"recall":0.0,"f1":0.0,"grounded_kc_rate":0.0}'), out.schema["micro"].dataType)
    none = F.from_json(F.lit('{"title_kind_accuracy":0.0,"matched_titles":0}'), out.schema["kinds"].dataType)
    metrics = F.struct(*[found(k).alias(name) for k, name in REPORTED.items()], F.coalesce("micro", nothing).alias("page_grounding"), F.coalesce("kinds", none).alias("kind_agreement"), F.col("checked").alias("pred_validation"))
    empty = F.from_json(F.lit('{"count":0,"examples":[]}'), out.schema["near"].dataType)
    by_title = lambda c: F.map_from_entries(or_empty(c))
    details = F.struct(by_title("page_list").alias("page_grounding_per_title"), by_title("kind_list").alias("kind_agreement_per_title"), or_empty("confusion").alias("kind_confusion"), or_empty("differences").alias("differences"), F.coalesce("near", empty).alias("text_only_near_matches"))
    return out.select("graph_id", F.to_json(F.struct("inputs", summary.alias("summary"), metrics.alias("metrics"), details.alias("details")), {"ignoreNullFields": "false"}).alias("json"))


def gold_relations(gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, pages) from gold JSON (graph_id, json). Edges may be [s, t] or [s, relation, t]."""
    schema = "nodes array<struct<id:string,title:string,kind:string>>, contains array<array<string>>, sequence array<array<string>>, grounding map<string,struct<pages:array<int>>>"
    g = gold.select("graph_id", F.from_json("json", schema).alias("g"))
    nodes = g.select("graph_id", F.posexplode("g.nodes").alias("pos", "n")).select("graph_id", F.col("pos").cast("long").alias("pos"), "n.id", "n.kind", "n.title", F.lit(None).cast("string").alias("number"))
    edge = lambda name: g.select("graph_id", F.explode(f"g.{name}").alias("e")).filter("size(e) >= 2").select("graph_id", F.col("e")[0].alias("source"), F.when(F.size("e") == 3, F.try_element_at("e", F.lit(3))).otherwise(F.col("e")[1]).alias("target"), F.lit(name).alias("type"))
    pages = g.select("graph_id", F.explode("g.grounding").alias("id", "v")).select("graph_id", "id", F.array_sort(F.array_distinct("v.pages")).alias("pages"))
    pages = pages.join(nodes.select("graph_id", "id", "pos"), ["graph_id", "id"])
    return nodes, edge("contains").unionByName(edge("sequence")), pages


def predicted_pages(nodes: DataFrame, profile: str = "eval") -> DataFrame:
    return nodes.select("graph_id", "pos", "id", T.predicted_pages(F.col("evidence_pages"), F.col("page_start"), F.col("page_end"), profile).alias("pages"))


__all__ = ["Canonical", "canonical", "carried_validation", "compare", "differences", "first_nodes", "gold_relations", "kind_accuracy", "kind_agreement", "kind_confusion", "near_matches", "page_grounding", "page_grounding_micro", "predicted_pages", "relations", "report", "set_metrics"]
