import hashlib
import random
import re

import pytest

from strata.llm import imatch

BREAK = re.compile(imatch.BREAK)


def terms(text):
    return set(BREAK.split(text.lower())) - {""}


@pytest.mark.parametrize(("ranges", "bound"), [(1, 10**6), (7, 10**6), (5, 0)])
def test_fingerprints(spark, ranges, bound):
    rng = random.Random(ranges)
    vocab = [f"Wörd{k}" for k in range(400)]
    rows = [(k * 7 - 20, " ".join(rng.choices(vocab, k=rng.choice([3, 40, 200])) + ["the"])) for k in range(120)]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1]), (None, "Wörd1, wörd2!"), (5, None), (6, ""), (10_002, "😀 wörd3 " * 3000), (10_003, "x"), (10_003, "x")]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(t, d, 0.5, "b") for d, t in shuffled], "text string, doc_id long, n double, bucket string")
    got = imatch.fingerprints(df, rarest=0.0, commonest=0.5, ranges=ranges, max_broadcast=bound).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = {}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.setdefault(d, []).append((t, t[: len(t) - half] + nxt[:half], nxt))
    df_of = {}
    for _, t in order:
        for w in terms(t):
            df_of[w] = df_of.get(w, 0) + 1
    lex = {w for w, n in df_of.items() if n >= 3 and (n <= 0.5 * len(order) or n <= 3)}
    assert "the" not in lex and len(got) == len(rows)
    prints = {}
    for r in got:
        (t, edited, nxt) = want[r["doc_id"]][0]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == "") == (not terms(t) & lex)
        if terms(t) & lex == terms(edited) & lex:
            assert r["fingerprint"] == r["edited_fingerprint"]
        assert prints.setdefault(frozenset(terms(t) & lex), r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == nxt and len(want[r["doc_id"]]) == 1:
            assert r["near_next"] == 1
        if t == edited:
            assert r["near_edited"] == 1
    long = [r for r in got if r["n_chars"] > 300 and r["doc_id"] < 800]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.8 * len(long)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.fingerprints(df).count() == 0
    r = imatch.fingerprints(spark.createDataFrame([(3, "alone")], "doc_id long, text string")).first()
    assert (r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) == (3, 5, 0.0, 1.0) and r["edited_sha256"] == hashlib.sha256(b"aloal").hexdigest()


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(6000)]
    base = rng.sample([f"g{k}" for k in range(900)], 300)
    rows = [(k, " ".join(rng.choices(vocab, k=40))) for k in range(1900)]
    for k in range(100):
        words = list(base)
        words[rng.randrange(300)] = rng.choice((f"one{k}", rng.choice(vocab)))
        rows.append((10_000 + k, " ".join(words)))
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = [r for r in got if r["doc_id"] >= 10_000]
    assert all(len(r["fingerprint"].split()) > 10 for r in group) and len({r["fingerprint"] for r in group}) > 50
    assert all(r["near_next"] > 0.5 and r["near_edited"] > 0 for r in group if r["doc_id"] != 10_099)
    rest = [r for r in got if r["doc_id"] < 1899]
    assert sum(r["near_next"] for r in rest) < 0.1 * len(rest)


@pytest.mark.parametrize("ranges", [2, 16])
def test_hot_ids_are_split_in_order(spark, ranges):
    rng = random.Random(ranges)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(1, 30)))
    rows = [(k, text()) for k in range(-30, 30)] + [(7, text()) for _ in range(90)] + [(None, text()) for _ in range(60)] + [(2**63 - 1, text()) for _ in range(40)]
    rows += [(7, rows[70][1]), (None, None), (8, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in imatch.fingerprints(df, ranges=ranges).collect())
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    edited = [t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (_, t) in enumerate(order)]
    assert got == sorted((repr(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for (d, t), e in zip(order, edited, strict=True))
    base = df.na.fill("", ["text"]).withColumn("md5", imatch.F.md5("text"))
    cut = imatch._ranges(base, ranges)
    bucket = {(r["doc_id"], r["md5"]): r["b"] for r in base.select("doc_id", "md5", imatch._bucket(base["doc_id"], base["md5"], cut).alias("b")).collect()}
    along = [bucket[d, hashlib.md5(t.encode()).hexdigest()] for d, t in order]
    assert along == sorted(along)
    if ranges == 16:
        assert all(len({b for (d, _), b in bucket.items() if d == hot}) > 2 for hot in (7, None, 2**63 - 1))
        assert max(along.count(b) for b in set(along)) < 40
