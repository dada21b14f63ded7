import re
from collections import Counter

import pytest

from strata.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(size, weights, epochs, budget):
    """Clamp and share again until no source is above its cap."""
    w = {s: weights[k % len(weights)] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, open_, total = {}, set(size), budget * sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > epochs * size[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        target |= {s: epochs * size[s] for s in full}
        open_ -= full
    return target


@pytest.mark.parametrize("sources", [[("b", 30), ("a", 5), ("é", 80), (None, 9)], [("x", 4)], [("x", 1), ("y", 100), ("z", 1), ("w", 1), ("v", 500)], [("x", 0), ("y", 3)]])
def test_water_filling(spark, sources):
    rows, k = [], 0
    for s, n in sources:
        for i in range(n):
            rows.append((k, s, "\n".join(["wörd"] * (1 + i * 7 % 23)), 1))
            k += 1
    rows += [(9001, sources[0][0], None, 1), (9002, sources[0][0], "", 1), (9003, sources[-1][0], "same", 1), (9003, sources[-1][0], "same", 1), (None, sources[-1][0], "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix_documents(df).collect()
    assert sorted(map(str, mixing.mix_documents(df.repartition(5)).collect())) == sorted(map(str, got))
    size, taken = Counter(), Counter()
    for _, s, t, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    want = fill(size, (3, 1, 2), 2.0, 1.5)
    of = {d: s for d, s, _, _ in rows}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5001 for s in size)


def test_empty(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
