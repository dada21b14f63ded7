import random
import re

import numpy as np
import pytest

from strata.llm import minhash
from strata.llm._bytes import word_hashes
from strata.llm._graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets), key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    out = []
    for g in range(n):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 8, 60, 150]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


def thue_morse(n):
    """Two words of n bytes that linear hashes modulo a power of two can't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize(("n", "num", "block"), [(3, 85, 16), (5, 80, 16), (3, 85, 40), (5, 80, 512)])
def test_against_brute_force(spark, n, num, block, monkeypatch):
    texts = made(n, 60)
    texts += [texts[0], texts[1].upper(), "", None, "Ünï one", "one"]
    # a hub with many copies at various distances: more than a block
    rng = random.Random(9)
    hub = [f"h{k}" for k in range(200)]
    for _ in range(70):
        w = list(hub)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append("\n".join(w))
    # words that a polynomial hash takes for equal, and a very long text with its copy
    a, b = thue_morse(2048)
    texts += [f"{a} {a} {a}", f"{b} {b} {b}", "p q r " * 20_000, "p q r " * 20_000 + "s"]
    rows = [(k * 3 % 1009, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None)]
    # repeated rows, and ids with several texts, which link their groups
    rows += [rows[5], rows[5], (2000, texts[7]), (2000, texts[9]), (2000, ""), (1999, texts[9]), (2001, texts[11] + " new words here"), (2001, texts[11])]
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, n int")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, n, num).collect()), key=str)
    assert got == brute(rows, n, num, 100)


@pytest.mark.parametrize("words", [1024, 4096])
def test_words_of_one_polynomial_hash_differ(words):
    a, b = thue_morse(words)
    buf = np.frombuffer((a + b).encode(), np.uint8)
    x, y = word_hashes(buf, np.array([0, words]), np.array([words, 2 * words]))
    assert x != y
    # and eight bytes at a time, with and without capitals
    text = " ".join(["Ab", "ab", "ab", "abcdefgh", "abcdefghi", "abcdefghI", a[:64], a[:65]])
    buf = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in text.split()]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    exact, lower = word_hashes(buf, starts, ends), word_hashes(buf, starts, ends, lower=True)
    assert len(set(exact.tolist())) == 7 and exact[1] == exact[2] == lower[0] == lower[1] and lower[4] == lower[5] and lower[7] == exact[7]


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(k, 2999) for k in range(2000, 2100)]
    edges += [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)] + [(7000, 7000), (7001, 7002), (7002, 7001)]
    rng.shuffle(edges)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {v: root(v) for v in ends}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    for small in (1, 5, 1000):
        a, b = np.sort(x[:small]), np.sort(x[small // 5 : small + small // 5])
        s = minhash.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 128)
        assert (s != ~np.uint64(0)).all()
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - j) < 0.15
