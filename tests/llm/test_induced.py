import random

import numpy as np
import pytest

from strata.llm import induced


def check(b, cap=200):
    t = np.frombuffer(b, np.uint8)
    order, prefix = induced.sort_suffixes(t, cap)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert order.tolist() == want
    for k, i in enumerate(want):
        j = want[k - 1] if k else None
        p = 0
        if k:
            while p < cap and max(i, j) + p < len(b) and b[i + p] == b[j + p]:
                p += 1
        assert prefix[k] == p, (k, i, j, p, prefix[k])


@pytest.mark.parametrize(("spill", "base"), [(1 << 30, 1 << 20), (0, 0), (1 << 30, 5)])
def test_against_sorted(monkeypatch, spill, base):
    monkeypatch.setattr(induced, "QUEUE_BYTES", spill)
    monkeypatch.setattr(induced, "BASE", base)
    rng = random.Random(1)
    check(b"")
    check(b"a")
    check(b"aaaaaaaa")
    check(b"mississippi" * 7)
    check(b"ab" * 300 + b"\xff" + b"ab" * 200)
    for n in (10, 50, 400):
        for letters in (b"ab", b"abc", bytes(range(256))):
            for _ in range(25):
                check(bytes(rng.choice(letters) for _ in range(n)), rng.choice([1, 5, 200]))
    words = [bytes(rng.choice(b"aeinst") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    for _ in range(10):
        text = b" ".join(rng.choice(words) for _ in range(400))
        check(text + b"\xff" + text[100:900] + b"\xff" + b"zz" * 50)
    base = b" ".join(rng.choice(words) for _ in range(3000))
    check(base)


def test_only_heads_of_chains_are_compared(monkeypatch):
    compared = []
    real = induced._common_pairs
    monkeypatch.setattr(induced, "_common_pairs", lambda t, a, b, bound: compared.append(len(a)) or real(t, a, b, bound))
    rng = random.Random(3)
    passage = bytes(rng.choice(b"aeinst ") for _ in range(600))
    # copies with surroundings of their own, and a last one that ends with the text
    text = b"\xff".join(bytes(rng.choice(b"aeinst ") for _ in range(20)) + passage for _ in range(8))
    for cap in (5, 200):
        compared.clear()
        check(text, cap)
        seeds = len(induced._lms(induced.types(np.frombuffer(text, np.uint8))))
        assert len(compared) == 1 and 0 < compared[0] < seeds / 4
    check(b"ab" * 700 + b"\xff" + b"ab" * 300 + b"\xff")


def test_pairs_up_to_their_bounds():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    t = np.frombuffer(base * 4 + b"c" + base, np.uint8)
    a = np.array([rng.randrange(len(t)) for _ in range(500)])
    b = np.array([x if x != y else (x + 1) % len(t) for x, y in zip((rng.randrange(len(t)) for _ in range(500)), a.tolist(), strict=True)])
    bound = np.array([rng.choice([0, 1, 7, 8, 9, 64, 1000]) for _ in range(500)])
    want = []
    for i, j, k in zip(a.tolist(), b.tolist(), bound.tolist(), strict=True):
        p = 0
        while p < k and max(i, j) + p < len(t) and t[i + p] == t[j + p]:
            p += 1
        want.append(p)
    assert induced._common_pairs(t, a, b, bound).tolist() == want
    assert induced._common_pairs(t, a[:3], b[:3], bound[:3]).tolist() == want[:3]
