"""Closed forms against small recursions."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import headings as H
from strata.operators import outline as O
from strata.operators import validate as V

SCHEMA = "doc_id int, ord array<int>, title string, number string, role string, start_page int, end_page int"


def tree(rng, depth=0):
    page = lambda: rng.choice([None, rng.randint(1, 9)])
    kids = [tree(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))]
    return {"t": rng.choice(["a", "b", "A ", ""] if depth else ["root"]), "s": page(), "e": page(), "k": kids}


def rows(doc, node, at=()):
    yield (doc, list(at), node["t"], None, None, node["s"], node["e"])
    for i, k in enumerate(node["k"]):
        yield from rows(doc, k, (*at, i + 1))


def spans(node):
    for k in node["k"]:
        spans(k)
    starts = [x for x in [node["s"], *(k["s"] for k in node["k"])] if x is not None]
    ends = [x for x in [node["e"], *(k["e"] for k in node["k"])] if x is not None]
    node["s"], node["e"] = min(starts, default=None), max(ends, default=None)
    if node["s"] is not None and node["e"] is not None and node["s"] > node["e"]:
        node["e"] = node["s"]


def clean(node):
    node["t"] = " ".join(node["t"].split())
    kept, seen = [], set()
    for k in node["k"]:
        if not k["t"].strip():
            continue
        clean(k)
        key = (k["t"].lower(), k["s"], k["e"])
        if key not in seen:
            seen.add(key)
            kept.append(k)
    node["k"] = kept


def flat(node):
    yield node["t"], node["s"], node["e"]
    for k in node["k"]:
        yield from flat(k)


@pytest.mark.parametrize("passes", [1, 2])
def test_normalize(spark, passes):
    rng = random.Random(passes)
    trees = {d: tree(rng) for d in range(80)}
    df = spark.createDataFrame([r for d, t in trees.items() for r in rows(d, t)], SCHEMA)
    got: dict = {}
    for r in O.normalize(df, passes).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["start_page"], r["end_page"]))
    for d, t in trees.items():
        for _ in range(passes):
            clean(t)
            spans(t)
        assert got[d] == list(flat(t))


def test_flatten(spark):
    docs = spark.createDataFrame([(1, '{"title":"C","sections":[{"title":"A","start_page":3,"sections":[{"title":"B","end_page":"x"}]},{"title":"D","start_page":true}]}'), (2, None)], "doc_id int, json string")
    got = [tuple(r) for r in O.flatten_outlines(docs).orderBy("ord").collect()]
    assert [(list(r[1]), r[2], r[5], r[6]) for r in got] == [([], "C", None, None), ([1], "A", 3, None), ([1, 1], "B", None, None), ([2], "D", None, None)]


def test_cycles():
    assert V.has_cycle([("a", "b"), ("b", "a")]) and V.has_cycle([("a", "a")])
    assert not V.has_cycle([("a", "b"), ("b", "c"), ("a", "c")])


def test_heading_parents(spark):
    lines = [("decimal", "1", 1), (None, None, 1), ("decimal", "1.2.3", 3), ("roman", "II", 1), ("decimal", "2.1", 2), ("bullet", None, 99), (None, None, 2), (None, None, 3), ("bullet", None, 99), ("decimal", "1.1", 2)]
    df = spark.createDataFrame([(1, i, n, k, d, 2 if k == "roman" else None) for i, (k, n, d) in enumerate(lines)], "doc_id int, i int, number string, numbering_type string, depth int, roman_index int")
    got = {r["i"]: r["parent"] for r in H.heading_parents(df).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 3, 5: 4, 6: None, 7: 6, 8: 7, 9: 0}


def test_unique_ids(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(["x", "x", "x-2", "x"])], "doc_id int, idx int, base string")
    assert [r["id"] for r in H.unique_ids(df).orderBy("idx").collect()] == ["x", "x-2", "x-2-2", "x-3"]
    assert df.select(F.lit(1)).count() == 4
