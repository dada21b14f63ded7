import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import _segments, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed):
    rng = random.Random(seed)
    vocab = ["alpha", "be", "gam", "ñu", "delta!", "x", "epsilonian", "of", "the"] + [f"v{k}" for k in range(400)]
    passages = [" ".join(rng.choices(vocab, k=80)) for _ in range(3)]
    out = []
    for _ in range(60):
        w = " ".join(rng.choices(vocab, k=rng.randint(1, 120)))
        if rng.random() < 0.5:
            p = rng.choice(passages)
            i = rng.randint(0, 100)
            w += rng.choice([" ", "\n", "z"]) + p[i : i + rng.randint(50, 500)] + " " + " ".join(rng.choices(vocab, k=20))
        out.append(w)
    return [*out, out[3], out[3], "the be " * 300, "the be " * 150, "aaaa" * 200, None, "", "short", passages[0][:199], passages[0][:200], ("long " + passages[1] + " ") * 40]


def brute_bytes(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    least = {}
    split = [(-1 if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, 10**9), d)
    out = []
    for d, w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < d:
                gone[i : i + length] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if d == -1 else d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 3])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_against_brute_force(spark, monkeypatch, kind, hot):
    monkeypatch.setattr(_segments, "HOT", hot)
    rng = random.Random(hot)
    rows = list(enumerate(texts(hot)))
    rng.shuffle(rows)
    # an id with several texts, one of them twice, and words that linear hashes can't tell apart
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows += [(None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1]), (7, rows[20][1] + " more"), (501, f"{x} " * 14), (502, f"{y} " * 14)]
    df = spark.createDataFrame([(t, d, "k", 1) for d, t in rows], "text string, doc_id long, tid string, id int")
    if kind == "bytes":
        got = suffix_dedup.remove_repeats(df, 200).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 200)
    else:
        got = substring_dedup.remove_seen(df, 13).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 13)


def test_very_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(_segments, "SCAN", 1000)
    rng = random.Random(4)
    p = " ".join(f"w{rng.randrange(500)}" for _ in range(100))
    rows = [(1, " ".join(f"a{rng.randrange(5000)}" for _ in range(2000)) + " " + p + " end " + p + " tail"), (2, "x " + p), (3, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, 200).collect()), key=str) == brute_bytes(rows, 200)
    assert sorted((tuple(r) for r in substring_dedup.remove_seen(df, 13).collect()), key=str) == brute_words(rows, 13)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(df).count() == 0 and substring_dedup.remove_seen(df).count() == 0


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(200):
        refs = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 4))]
        q = [rng.randrange(3) for _ in range(15)]
        a = substring_dedup.SuffixAutomaton()
        for r in refs:
            a.add(r)
        subs = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i, len(r) + 1)} | {()}
        assert a.matching(q) == [max(n for n in range(i + 2) if tuple(q[i + 1 - n : i + 1]) in subs) for i in range(len(q))]


@pytest.mark.parametrize("size", [1, 3000])
def test_large_keys_are_cut(spark, monkeypatch, size):
    monkeypatch.setattr(_segments, "KEY_BYTES", size)
    sizes = []
    divide = _segments.divide

    def watched(merged, spec):
        out, levels = divide(merged, spec)
        sizes.append((levels, [r["count"] for r in out.groupBy("key").count().collect()]))
        return out, levels

    monkeypatch.setattr(_segments, "divide", watched)
    rng = random.Random(size)
    vocab = [f"v{k}" for k in range(3000)]
    shared = " ".join(rng.choices(vocab, k=80))[:400]
    rows = list(enumerate(texts(size)[:40])) + [(1000 + k, " ".join(rng.choices(vocab, k=50)) + " " + shared + " " + " ".join(rng.choices(vocab, k=50))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, 200).collect()), key=str) == brute_bytes(rows, 200)
    assert sorted((tuple(r) for r in substring_dedup.remove_seen(df, 13).collect()), key=str) == brute_words(rows, 13)
    assert len(sizes) == 2 and sizes[0][0]
    # a key of 3,000 bytes has 15 segments of 200 bytes at most
    assert max(sizes[0][1]) <= 15


def test_only_segments_that_can_match_are_streamed(monkeypatch):
    calls = []
    for name in ("add", "matching"):
        real = getattr(substring_dedup.SuffixAutomaton, name)
        monkeypatch.setattr(substring_dedup.SuffixAutomaton, name, lambda self, w, name=name, real=real: calls.append((name, tuple(w))) or real(self, w))
    seg = {d: (*range(7, 12), *range(100 * d, 100 * d + 3)) for d in (1, 2, 4, 5, 6)} | {3: tuple(range(20, 28))}
    # key, doc_id: a pair, a document by itself, three documents, one merged segment
    rows = [(1, 1), (1, 2), (2, 3), (2, 3), (3, 4), (3, 5), (3, 6), (4, 6)]
    content = [np.array(seg[d], np.int64).tobytes() for _, d in rows]
    count = [1] * 7 + [2]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    cols = [[0] * 8, [k for k, _ in rows], [bytes([x]) * 16 for x in range(8)], [d for _, d in rows], count, [4] * 8, content]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "key", "seg", "least", "count", "n", "content"])
    run = _segments._kernel(substring_dedup.flag_shard(5))
    parts = [b for b in run(iter([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2)]))]
    got = [(r["key"], r["least"], r["bits"]) for b in parts for r in b.to_pylist()]
    assert got == [(1, 2, b"\x01"), (3, 5, b"\x01"), (3, 6, b"\x01"), (4, 6, b"")]
    assert calls == [("add", seg[1]), ("matching", seg[2]), ("add", seg[4]), ("matching", seg[5]), ("add", seg[5]), ("matching", seg[6])]


def test_coverage_of_many_texts_at_once():
    rng = random.Random(5)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())]))
    sizes = [0, 40, 3, 25, 0, 60, 13]
    spans = []
    for size in sizes:
        of = []
        for _ in range(rng.randint(1, 4) if size >= 13 else 0):
            start = rng.randint(0, size - 13)
            n = rng.randint(1, size - 13 - start + 1)
            bits = np.packbits([rng.random() < 0.2 for _ in range(n)], bitorder="little").tobytes()
            of.append({"start": start, "n": n, "bits": rng.choice([None, bits])})
        spans.append(of or None)
    for a in (0, 1, 2):
        off = np.concatenate(([0], np.cumsum(sizes[a:])))
        each = [_segments.covered(n, s or [], 13) for n, s in zip(sizes[a:], spans[a:], strict=True)]
        assert _segments.all_covered(off, pa.array(spans, kind).slice(a), 13).tolist() == np.concatenate(each).tolist()
    assert _segments.all_covered(np.zeros(1, int), pa.array([], kind), 13).tolist() == []


def test_only_six_bytes_part_words(spark):
    odd = "\x1c \x1d\t\x1e\n\x1f\x0b\x85\x0c\xa0\r  a\x00b 　 c\x1cd e\xa0f g h i"
    rows = [(1, odd), (2, "x " + odd + " y"), (3, odd.replace("\xa0", " "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.remove_seen(df, 13).collect()), key=str) == brute_words(rows, 13)
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.remove_seen(df, 13, with_text=True).collect()}[2] == "x y"


def test_a_task_takes_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "Windows", lambda *a, **k: _segments.Windows(*a, **(k | {"shard_bytes": 500})))
    tasks, shards = [], []
    staged = _segments.staged

    def watched(df, name):
        if name == "flags":
            tasks.append(df.rdd.getNumPartitions())
        out = staged(df, name)
        if name == "merged":
            shards.append(sum(len(r["content"]) for r in out.collect()) // 500)
        return out

    monkeypatch.setattr(_segments, "staged", watched)
    rows = list(enumerate(texts(6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.remove_seen(df, 13).collect()), key=str) == brute_words(rows, 13)
    assert shards[0] > 20 and tasks == [4]


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_anchors_are_found_in_one_scan(spark, monkeypatch, kind):
    scans = []
    monkeypatch.setattr(_segments, "lean", lambda kernel: scans.append(kernel.__qualname__.partition(".")[0]) or kernel)
    # repeats inside texts and across, and a text that is only a copy of another
    p = " ".join(f"w{k}" for k in range(80))
    rows = [(1, f"a {p} b {p}"), (2, "c d e " * 80), (3, "c d e " * 80), (4, f"{p} z"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if kind == "bytes":
        assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, 200).collect()), key=str) == brute_bytes(rows, 200)
    else:
        assert sorted((tuple(r) for r in substring_dedup.remove_seen(df, 13).collect()), key=str) == brute_words(rows, 13)
    assert scans == ["_pairs", "_contents", "_kernel"]


def test_anchors_of_a_text_in_pieces(monkeypatch):
    monkeypatch.setattr(_segments, "SCAN", 500)
    spec = _segments.Windows("bytes", 200, 32, True, 2 << 20)
    rng = random.Random(8)
    p = "".join(rng.choice("abcdef ") for _ in range(300))
    texts_ = ["", p + "x" * 900 + p, p, "short", p + p]
    ids = [7, 1, 2, 3, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([bytes([k]) for k in range(5)]), pa.array(texts_)], ["id", "tid", "text"])
    got = pa.Table.from_batches(list(_segments._pairs(spec)(iter([batch])))).to_pylist()
    assert len({(r["anchor"], r["tid"]) for r in got}) == len(got)
    times = {}
    for r in got:
        times.setdefault(r["tid"], {})[r["anchor"]] = r["n"]
        assert r["id"] == ids[r["tid"][0]]
    assert set(times) == {b"\x01", b"\x02", b"\x04"}
    # the passage's anchors are there once, and twice in the texts that have it twice
    whole = [a for a, n in times[b"\x02"].items() if n == 1]
    assert whole and all(times[b"\x04"][a] >= 2 for a in whole) and any(times[b"\x01"][a] >= 2 for a in whole)
