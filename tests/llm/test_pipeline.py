import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strata.llm._shared import staged

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1)).withColumn("kept", F.lit("k"))
    more = spark.createDataFrame([(9001, None, "en", "src1", 0, 1, "k"), (9002, "123 456 --", None, None, 3, 1, "k"), (9003, "the and of " * 3, "en", None, 3, 1, "k")], docs.schema)
    docs = staged(docs.unionByName(more), "docs")
    steps = dict(cp.STAGES)
    out = {}
    frame = docs
    for name, f in cp.STAGES[:-1]:
        frame = staged(f(spark, frame, SF), name)
        assert frame.columns == docs.columns
        out[name] = [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]
    ids = lambda name: sorted(r[0] for r in out[name])
    assert set(ids("language_id")) == {r[0] for r in docs.select("doc_id").collect()} - {9001, 9002}
    groups = brute([r[:2] for r in out["language_id"]], 5, 80, 100)
    assert ids("near_dedup") == sorted(g[0] for g in groups if g[3])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    squeeze = lambda t: " " + " ".join(re.sub(r"[^\w ]", "", w) for w in t.lower().split()) + " "
    dirty = {d for d, t, _ in out["near_dedup"] if any(squeeze(i) in squeeze(t) for i in items)}
    assert dirty and ids("decontaminate") == [d for d in ids("near_dedup") if d not in dirty]
    size = Counter()
    for _, t, s in out["decontaminate"]:
        size[s] += len(WORD.findall(t))
    taken, times = Counter(), Counter(ids("mix_sources"))
    for _, t, s in out["mix_sources"]:
        taken[s] += len(WORD.findall(t))
    assert max(times.values()) <= 2 and set(times) <= set(ids("decontaminate"))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, open_, budget = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    longest = {s: max(len(WORD.findall(t)) for _, t, x in out["decontaminate"] if x == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in size)
    rows = [tuple(r) for r in steps["token_output"](spark, frame, SF).orderBy("start").collect()]
    lib, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    want = sorted((d, t) for d, t, _ in out["mix_sources"])
    assert len(rows) == len(want)
    for (d, t), r in zip(want, rows, strict=True):
        ids_ = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert r[:4] == (d, start, len(ids_), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids_)))
        start += len(ids_)


def test_empty_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in cp.STAGES:
        frame = staged(f(spark, frame, SF), name)
        assert frame.count() == 0


@pytest.mark.parametrize("bad", ["text", "source", "lang", "doc_id"])
def test_null_columns(spark, bad):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    frame = docs.withColumn(bad, F.lit(None).cast(docs.schema[bad].dataType))
    for name, f in cp.STAGES:
        frame = staged(f(spark, frame, SF), name)
    # without text, or without anything to learn languages from, the first stage rejects every document
    assert (frame.count() == 0) == (bad in ("text", "lang", "doc_id"))
