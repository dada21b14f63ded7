"""Graphs and reports as JSON, CSV, DOT and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators.errors import COUNTERS, LABELS

# The preamble of a DOT file and the style (shape, colour, style) of each kind.
PREAMBLE = [
    "digraph ECG {",
    "  rankdir=TB;",
    "  graph [fontsize=10, overlap=false, splines=true];",
    "  node [fontsize=10];",
    "  edge [fontsize=9];",
]
STYLES = {
    "COURSE": ("box", "lightblue", "filled,bold"),
    "MODULE": ("box", "lightgreen", "filled"),
    "UNIT": ("ellipse", "gold", "filled"),
    "KC": ("note", "lightpink", "filled"),
}
PLAIN = ("box", "white", "filled")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, part, pos, line): preamble, nodes, edges and the closing brace of each graph's DOT file."""
    style = F.lit(None)
    for kind, values in STYLES.items():
        style = F.when(F.coalesce("kind", F.lit("KC")) == kind, F.struct(*[F.lit(v).alias(k) for k, v in zip(("shape", "color", "style"), values, strict=True)])).otherwise(style)
    style = F.coalesce(style, F.struct(*[F.lit(v).alias(k) for k, v in zip(("shape", "color", "style"), PLAIN, strict=True)]))
    label = F.replace(T.clean_text(F.coalesce("label", "id")), F.lit('"'), F.lit('\\"'))
    n = nodes.withColumn("s", style).select("graph_id", F.lit(1).alias("part"), "pos", F.format_string('  "%s" [label="%s", shape="%s", style="%s", fillcolor="%s"];', F.col("id"), label, F.col("s.shape"), F.col("s.style"), F.col("s.color")).alias("line"))
    solid, dashed = F.format_string('  "%s" -> "%s" [label="contains"];', "source", "target"), F.format_string('  "%s" -> "%s" [style=dashed, label="sequence"];', "source", "target")
    e = edges.select("graph_id", F.lit(2).alias("part"), "pos", F.when(F.coalesce("type", F.lit("contains")) == "contains", solid).otherwise(dashed).alias("line"))
    ids = nodes.select("graph_id").distinct()
    head = ids.select("graph_id", F.lit(0).alias("part"), F.posexplode(F.array(*[F.lit(x) for x in PREAMBLE])).alias("pos", "line")).select("graph_id", "part", F.col("pos").cast("long").alias("pos"), "line")
    tail = ids.select("graph_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("}").alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(tail)


def joined_lines(lines: DataFrame) -> DataFrame:
    """(graph_id, text): the lines of each graph in order."""
    return lines.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def node_csv(nodes: DataFrame) -> DataFrame:
    """(graph_id, pos, id, kind, title, number, page_start, page_end, path) as text, null as ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return nodes.select("graph_id", "pos", *[text(c) for c in ("id", "kind", "title", "number", "page_start", "page_end")], F.array_join("path", " > ").alias("path"))


def edge_csv(edges: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return edges.select("graph_id", "pos", *[text(c) for c in ("source", "target", "type")])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder for each graph, rows in order, quoted where needed, lines ended by CR LF."""
    ordered = rows.repartition("graph_id").sortWithinPartitions("graph_id", "pos").drop("pos")
    ordered.write.partitionBy("graph_id").mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_text(rows: DataFrame, path: str) -> None:
    """(graph_id, text) as a folder for each graph with one text file."""
    rows.select("graph_id", "text").repartition("graph_id").write.partitionBy("graph_id").mode("overwrite").option("lineSep", "\n").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame, violations: DataFrame, envelope: DataFrame) -> DataFrame:
    """(graph_id, json): metadata, nodes, edges and validation of each graph; lists are gathered here only."""
    of = lambda rows, columns, name: rows.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("x")))), lambda r: r["x"]).alias(name))
    n = of(nodes, ["id", "label", "kind", "title", "number", "role", "page_start", "page_end", "evidence_pages", "path"], "nodes")
    e = of(edges, ["source", "target", "type"], "edges")
    ranked = violations.withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("type", "node_id", "parent_id", "child_id", "source", "target")))
    v = of(ranked, ["type", "node_id", "parent_id", "child_id", "source", "target"], "violations")
    none = lambda c, like: F.coalesce(c, F.from_json(F.lit("[]"), like))
    all_ = envelope.join(n, "graph_id").join(e, "graph_id", "left").join(v, "graph_id", "left")
    meta = F.struct("course_title", "node_count", "edge_count", "validation_ok", "violation_count").alias("metadata")
    body = F.struct(meta, "nodes", none("edges", e.schema["edges"].dataType).alias("edges"), F.struct(F.col("validation_ok").alias("ok"), none("violations", v.schema["violations"].dataType).alias("violations")).alias("validation"))
    return all_.select("graph_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def pretty_json(text: str) -> str:
    """Two spaces of indentation, letters as they are. For single reports."""
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2)


def error_csv(wide: DataFrame, name: str = "graph_id") -> DataFrame:
    """(part, document, line): a header, then each document and its counters joined by commas, without quoting."""
    rows = wide.select(F.lit(1).alias("part"), F.col(name).cast("string").alias("document"), F.concat_ws(",", F.col(name).cast("string"), *[F.col(c).cast("string") for c in COUNTERS]).alias("line"))
    return _headed(rows, [",".join(["document", *COUNTERS])])


def error_markdown(wide: DataFrame, name: str = "graph_id") -> DataFrame:
    """(part, document, line): heading and pipe table of every document."""
    cells = F.concat_ws(" | ", F.col(name).cast("string"), *[F.col(c).cast("string") for c in COUNTERS])
    rows = wide.select(F.lit(1).alias("part"), F.col(name).cast("string").alias("document"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return _headed(rows, ["# Structural Error Report", "", f"| {' | '.join(['document', *(LABELS[c] for c in COUNTERS)])} |", "|---" * (1 + len(COUNTERS)) + "|"])


def _headed(rows: DataFrame, head: list[str]) -> DataFrame:
    lines = rows.sparkSession.createDataFrame([(0, f"{k:04d}", line) for k, line in enumerate(head)], "part int, document string, line string")
    return lines.unionByName(rows)


def write_lines(lines: DataFrame, path: str) -> None:
    """(part, document, line) as text files whose names order them."""
    lines.orderBy("part", "document").select("line").write.mode("overwrite").option("lineSep", "\n").text(path)


# The labels of the evaluation's metrics.
METRICS = {"nodes_by_title": "Node recovery (title)", "nodes_by_title_and_kind": "Node recovery (title+kind)", "contains": "Hierarchy recovery (contains)", "sequence": "Order recovery (sequence)"}


def _shown(report: dict, comma: str) -> dict[str, str]:
    """What a summary says of an evaluation, by label."""
    m = report["metrics"]
    ratios = lambda x: comma.join(f"{name}={x[key]:.3f}" for name, key in (("P", "precision"), ("R", "recall"), ("F1", "f1")))
    wide = comma if comma.strip() else 2 * comma
    out = {label: ratios(m[key]) for key, label in METRICS.items()}
    out["Page grounding"] = f"{ratios(m['page_grounding'])}{wide}grounded_rate={m['page_grounding']['grounded_kc_rate']:.3f}"
    out["Kind agreement"] = f"acc={m['kind_agreement']['title_kind_accuracy']:.3f}{wide}matched_titles={m['kind_agreement']['matched_titles']}"
    out["Pred validation"] = f"ok={m['pred_validation']['ok']}{wide}violations={m['pred_validation']['violation_count']}"
    return out | {"Text-only near matches": f"count={report['details']['text_only_near_matches']['count']}"}


def evaluation_markdown(text: str) -> str:
    """The Markdown summary of one evaluation report (JSON)."""
    got = json.loads(text)
    given = got["inputs"] or {"gold": None, "pred": None, "include_course": False}
    head = [f"- {label}: `{given[key]}`" for label, key in (("Gold", "gold"), ("Prediction", "pred"), ("Include COURSE", "include_course"))]
    return "\n".join(["# ECG Evaluation Summary", "", *head, "", *(f"- **{k}**: {v}" for k, v in _shown(got, ", ").items())]) + "\n"


def console_summary(text: str) -> str:
    """The summary of one evaluation report (JSON) for a terminal."""
    got = json.loads(text)
    rule = "=" * 72
    counts = [f"{f'{side.capitalize()} {label}':16s}: {got['summary'][f'{side}_{key}_count']}" for key, label in (("node", "nodes"), ("contains", "contains"), ("sequence", "sequence")) for side in ("gold", "pred")]
    return "\n".join(["", "ECG evaluation summary", rule, *counts, "-" * 72, *(f"{k:30s} {v}" for k, v in _shown(got, " ").items()), rule]) + "\n"
