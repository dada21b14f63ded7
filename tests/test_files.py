"""From files to files: sources, compilation, sinks, reports."""

import csv
import glob
import io
import json

from strata.operators import errors as R
from strata.operators import evaluate as E
from strata.operators import headings as H
from strata.operators import pages as P
from strata.operators import toc as C
from strata.plans import compile as K
from strata.sources import readers, sinks

OUTLINE = {
    "title": " A  course ",
    "sections": [
        {"title": "One", "number": "1", "start_page": 2, "sections": [{"title": "Leaf, a \"quoted\" one", "number": "1.1", "start_page": 3, "end_page": 4}, {"title": "leaf, a \"quoted\" one", "number": "1.1", "start_page": 3, "end_page": 4}]},
        {"title": "", "sections": [{"title": "Gone with its parent"}]},
        {"title": "Two", "start_page": True},
    ],
}


def text_of(path):
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_outlines_to_bundles(spark, tmp_path):
    for k, tree in enumerate([OUTLINE, {"title": "Other", "sections": []}, None]):
        (tmp_path / "in" / f"d{k}").mkdir(parents=True)
        (tmp_path / "in" / f"d{k}" / "outline_clean.json").write_text(json.dumps(tree) if tree else "no json {")
    K.build(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    folder = lambda kind, k: f"{tmp_path}/out/{kind}/graph_id=d{k}%2Foutline_clean"
    ecg = json.loads(text_of(folder("ecg", 0)))
    assert ecg["metadata"]["course_title"] == "A course" and ecg["metadata"]["node_count"] == 4 == len(ecg["nodes"])
    assert [n["title"] for n in ecg["nodes"]] == ["A course", "One", 'Leaf, a "quoted" one', "Two"]
    assert [n["kind"] for n in ecg["nodes"]] == ["COURSE", "MODULE", "KC", "KC"]
    assert [(n["page_start"], n["page_end"]) for n in ecg["nodes"]] == [(2, 4), (2, 4), (3, 4), (None, None)]
    assert [(e["type"]) for e in ecg["edges"]] == ["contains", "contains", "contains", "sequence"] or len(ecg["edges"]) == 4
    ids = [n["id"] for n in ecg["nodes"]]
    assert {(e["source"], e["target"], e["type"]) for e in ecg["edges"]} == {(ids[0], ids[1], "contains"), (ids[0], ids[3], "contains"), (ids[1], ids[2], "contains"), (ids[1], ids[3], "sequence")}
    validation = json.loads(text_of(folder("validation", 0)))
    assert not validation["ok"] and [v["type"] for v in validation["violations"]] == ["kc_missing_page_grounding"]
    summary = json.loads(text_of(folder("summary", 0)))
    assert summary["outline_top_sections"] == 2 and summary["counts_by_kind"] == {"COURSE": 1, "MODULE": 1, "UNIT": 0, "KC": 2}
    assert summary["counts_by_edge_type"] == {"contains": 3, "sequence": 1} and summary["kc_grounding_coverage"] == {"grounded_kcs": 1, "total_kcs": 2, "percent": 50.0}
    assert summary["hierarchy_depth"] == {"max_path_length": 3, "depth_by_kind": {"COURSE": {"min": 1, "max": 1, "avg": 1.0}, "MODULE": {"min": 2, "max": 2, "avg": 2.0}, "UNIT": {"min": 0, "max": 0, "avg": 0.0}, "KC": {"min": 2, "max": 3, "avg": 2.5}}}
    dot = text_of(folder("dot", 0)).split("\n")
    assert dot[0] == "digraph ECG {" and "}" in dot[-2:] and sum("->" in x for x in dot) == 4 and any('Leaf, a \\"quoted\\" one' in x for x in dot)
    nodes = list(csv.DictReader(io.StringIO(text_of(folder("nodes", 0)))))
    assert [n["title"] for n in nodes] == ["A course", "One", 'Leaf, a "quoted" one', "Two"] and nodes[2]["path"] == 'A course > One > Leaf, a "quoted" one'
    edges = list(csv.DictReader(io.StringIO(text_of(folder("edges", 0)))))
    assert [(e["source"], e["target"], e["type"]) for e in edges] == [(e["source"], e["target"], e["type"]) for e in ecg["edges"]]
    other = json.loads(text_of(folder("ecg", 1)))
    assert other["metadata"]["node_count"] == 1 and other["edges"] == []
    assert not glob.glob(folder("ecg", 2))  # no JSON, no graph


GOLD = {
    "nodes": [{"id": "a", "title": "1. Alpha", "kind": "MODULE"}, {"id": "b", "title": "1.1. Beta", "kind": "KC"}, {"id": "c", "title": "1.2. Gamma", "kind": "KC"}],
    "contains": [["a", "b"], ["a", "contains", "c"]],
    "sequence": [["b", "c"]],
    "grounding": {"b": {"pages": [2, 1]}, "c": {"pages": [3]}},
}
PRED = {
    "metadata": {"violation_count": 7, "validation_ok": False},
    "nodes": [
        {"id": "x", "label": "Alpha", "kind": "MODULE", "title": "Alpha", "number": "1", "path": ["Alpha"]},
        {"id": "y", "label": "Beta", "kind": "UNIT", "title": "Beta", "number": "1.1", "page_start": 1, "page_end": 1, "path": ["Alpha", "Beta"]},
        {"id": "z", "label": "Gamma", "kind": "KC", "title": "Gamma", "number": "1.3", "evidence_pages": [3], "path": ["Alpha", "Gamma"]},
    ],
    "edges": [{"source": "x", "target": "y", "type": "contains"}, {"source": "x", "target": "z", "type": "contains"}, {"source": "y", "target": "z", "type": "sequence"}],
    "validation": {"ok": True, "violations": [{"type": "t"}]},
}


def pair(spark, tmp_path, profile):
    for name, x in (("gold", GOLD), ("pred", PRED)):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "g1.json").write_text(json.dumps(x))
    gold = readers.json_documents(spark, f"{tmp_path}/gold").withColumnRenamed("doc_id", "graph_id")
    pred = readers.json_documents(spark, f"{tmp_path}/pred/*.json")
    nodes, edges, pages = E.gold_relations(gold)
    m, f = readers.graphs(pred)
    carried = E.carried_validation(pred.withColumnRenamed("doc_id", "graph_id"))
    return E.canonical(nodes, edges, pages, profile, numbered=False), E.canonical(m, f, E.predicted_pages(m, profile), profile), carried


def test_evaluation_report(spark, tmp_path):
    gold, pred, carried = pair(spark, tmp_path, "eval")
    inputs = spark.createDataFrame([("g1", "g.json", "p.json", False)], "graph_id string, gold string, pred string, include_course boolean")
    (row,) = E.report(gold, pred, carried, inputs).collect()
    got = json.loads(row["json"])
    assert got["inputs"] == {"gold": "g.json", "pred": "p.json", "include_course": False}
    assert got["summary"] == {"gold_node_count": 3, "pred_node_count": 3, "gold_contains_count": 2, "pred_contains_count": 2, "gold_sequence_count": 1, "pred_sequence_count": 1}
    m, d = got["metrics"], got["details"]
    assert m["nodes_by_title"] == {"tp": 2, "fp": 1, "fn": 1, "precision": 0.666667, "recall": 0.666667, "f1": 0.666667, "jaccard": 0.5}
    assert m["nodes_by_title_and_kind"]["tp"] == 1 and m["contains"]["tp"] == 1 and m["sequence"]["tp"] == 0
    assert m["pred_validation"] == {"ok": True, "violation_count": 1} and m["kind_agreement"] == {"title_kind_accuracy": 0.5, "matched_titles": 2}
    assert [(k, v["gold_pages"], v["pred_pages"], v["tp"], v["fn"]) for k, v in d["page_grounding_per_title"].items()][0][1:] == ([1, 2], [1], 1, 1)
    assert [v["match"] for v in d["kind_agreement_per_title"].values()] == [True, False]
    assert d["kind_confusion"] == [{"gold": "KC", "pred": "UNIT", "count": 1}, {"gold": "MODULE", "pred": "MODULE", "count": 1}]
    assert len(d["differences"]["missing_titles"]) == len(d["differences"]["extra_contains"]) == 1
    assert d["text_only_near_matches"]["count"] == 1 and d["text_only_near_matches"]["examples"][0]["text_norm"] == "gamma"
    shown = sinks.console_summary(row["json"]).split("\n")
    assert shown[1] == "ECG evaluation summary" and "Gold nodes      : 3" in shown and "Node recovery (title)          P=0.667 R=0.667 F1=0.667" in shown
    assert "Text-only near matches         count=1" in shown and "Pred validation                ok=True  violations=1" in shown
    lines = sinks.evaluation_markdown(row["json"]).split("\n")
    assert lines[:3] == ["# ECG Evaluation Summary", "", "- Gold: `g.json`"] and "- **Node recovery (title)**: P=0.667, R=0.667, F1=0.667" in lines and "- **Kind agreement**: acc=0.500, matched_titles=2" in lines


def test_error_report(spark, tmp_path):
    gold, pred, _ = pair(spark, tmp_path, "report")
    docs = spark.createDataFrame([("g1", "D1", "g.json", "p.json"), ("g2", "D2", None, None)], "graph_id string, document string, gold_path string, pred_path string")
    got = {r["graph_id"]: json.loads(r["json"]) for r in R.report(gold, pred, docs).collect()}
    one = got["g1"]
    assert one["document"] == "D1" and one["counts"] == {c: len(one["details"][c]) for c in R.COUNTERS}
    assert one["counts"]["missing_titles"] == one["counts"]["extra_titles"] and set(got["g2"]["counts"].values()) == {0}
    wide = R.counters(gold, pred, docs)
    assert {c: wide.filter("graph_id = 'g1'").first()[c] for c in R.COUNTERS} == one["counts"]
    sinks.write_lines(sinks.error_csv(wide), f"{tmp_path}/csv")
    lines = text_of(f"{tmp_path}/csv").split("\n")
    assert lines[0] == "document,missing_titles,extra_titles,wrong_node_kinds,missing_contains_edges,extra_contains_edges,missing_sequence_edges,extra_sequence_edges,page_grounding_errors"
    assert lines[1].startswith("g1,") and lines[2] == "g2,0,0,0,0,0,0,0,0"
    sinks.write_lines(sinks.error_markdown(wide), f"{tmp_path}/md")
    lines = text_of(f"{tmp_path}/md").split("\n")
    assert lines[:2] == ["# Structural Error Report", ""] and lines[2].startswith("| document | missing titles |") and lines[3] == "|---" * 9 + "|" and lines[5] == "| g2 |" + " 0 |" * 8


def test_report_of_many_documents_is_whole(spark):
    wide = spark.range(1500).selectExpr("CAST(id AS STRING) AS graph_id", *[f"id AS {c}" for c in R.COUNTERS])
    assert sinks.error_markdown(wide).count() == 1504 and sinks.error_csv(wide).count() == 1501


def test_responses(spark):
    say = lambda c: json.dumps({"choices": [{"message": {"content": c}}]})
    rows = [(1, json.dumps({"output_text": "out"})), (2, say("[1] see the outline")), (3, say([{"text": "a"}, {"type": "x"}, {"text": "b"}])), (4, say(None)), (5, "no json"), (6, None)]
    got = {r["doc_id"]: r["text"] for r in P.response_text(spark.createDataFrame(rows, "doc_id long, json string")).collect()}
    assert got == {1: "out", 2: "[1] see the outline", 3: "a\n\nb", 4: "", 5: "", 6: ""}


def test_long_chains_and_many_equal_titles(spark):
    items = [(1, "texts", 0, "#/texts/0", "#/groups/0", "t", "text", None, None, "body", None)]
    items += [(1, "groups", k, f"#/groups/{k}", f"#/groups/{k + 1}" if k < 199 else "#/body", None, "list", None, None, "body", None) for k in range(200)]
    items += [(2, "texts", 0, "#/texts/0", "#/groups/0", "t", "text", None, None, "body", None), (2, "groups", 0, "#/groups/0", "#/groups/1", None, "list", None, None, "body", None), (2, "groups", 1, "#/groups/1", "#/groups/0", None, "form_area", None, None, "body", None)]
    df = spark.createDataFrame(items, "doc_id int, collection string, idx long, self_ref string, parent_ref string, text string, label string, level int, name string, content_layer string, page_no int")
    got = H.ancestors(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 201, 2: 2}
    assert [tuple(r) for r in H.local_areas(df).collect()] == [(2, "#/texts/0")]
    same = spark.range(20_000).selectExpr("1 AS doc_id", "id AS idx", "CASE WHEN id = 3 THEN 'x-2' ELSE 'x' END AS base")
    ids = [r["id"] for r in H.unique_ids(same).orderBy("idx").collect()]
    assert ids[:5] == ["x", "x-2", "x-3", "x-2-2", "x-4"] and len(set(ids)) == 20_000


def test_one_document_of_many_lines(spark):
    import time

    from strata.operators import outline as O

    n = 100_000
    rows = spark.range(n).selectExpr("1 AS doc_id", "CAST(id AS INT) AS i", "CAST(1 + id * 7919 % 5 AS INT) AS level", "CAST(id AS INT) AS start_page", "CAST(200000 AS INT) AS total_pages")
    began = time.time()
    got = O.end_page_by_level(O.nest_by_level(rows)).orderBy("i").collect()
    assert time.time() - began < 60
    stack, want = [], []
    for r in got:
        while stack and stack[-1][0] >= r["level"]:
            stack.pop()
        want.append(stack[-1][1] if stack else None)
        stack.append((r["level"], r["i"]))
    assert [r["parent"] for r in got] == want


def test_toc_options(spark):
    pages = spark.createDataFrame([(1, p, t, 0, 9) for p, t in ((1, "Title"), (2, "Contents\nOne 3\nTwo 4\nThree 5"), (3, "text"))], "doc_id int, page int, text string, links int, total_pages int")
    lines = spark.createDataFrame([(1, 2, 0, "1. One 3", 72.0, 0.0, 9), (1, 3, 0, "2. Other 4", 72.0, 0.0, 9)], "doc_id int, page int, line_pos int, text string, x0 double, y0 double, total_pages int")
    marks = C.embedded_entries(spark.createDataFrame([(1, 0, 1, "Mark", 3, 9)], "doc_id int, order int, level int, title string, page int, total_pages int"))
    titles = lambda **more: [r["title"] for r in C.entries(marks, lines, pages, **more).orderBy("order").collect()]
    assert titles() == ["Mark"]
    assert len(titles(prefer_embedded=False)) == 1 and "One" in titles(prefer_embedded=False)[0]
    assert len(titles(prefer_embedded=False, given=[3, 2])) == 2 and "Other" in titles(prefer_embedded=False, given=[3, 2])[0]
    assert titles(prefer_embedded=False, auto_detect=False) == []
