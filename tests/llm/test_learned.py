import random
import zlib

import pytest

from strata.llm import langid, quality

EN, DE = "the of and to in is that for was with".split(), "der die und den von das mit sich auf ist".split()


def corpus(n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        lang = ("en", "de")[k % 2]
        words = rng.choices((EN, DE)[k % 2], k=rng.randint(5, 60))
        good = k % 3 > 0
        rows.append((k, " ".join(words if good else [f"{w.upper()}!!" for w in words]), lang, int(good)))
    return rows


def test_quality(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(d, t, 0.3, True) for d, t, _, _ in rows] + [(9001, None, 0.1, None), (9002, "", 0.2, None), (None, "the and", 0.1, None), (9003, "the of and " * 50000, 0.1, None), (5, rows[5][1], 0.1, None)], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(d, q, 0) for d, _, _, q in rows] + [(None, 1, 0), (7, None, 0), (99999, 1, 0)], "doc_id long, quality long, toxic long")
    got = quality.score_quality(docs, labels, max_rows=200, bits=14).collect()
    assert len(got) == docs.count()
    truth = {d: q for d, _, _, q in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    again = quality.score_quality(docs.repartition(7), labels, max_rows=200, bits=14).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quality_without_rows(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality long")
    assert quality.score_quality(docs, labels, bits=10).first()["score"] == 0.5
    assert quality.score_quality(docs.limit(0), labels, bits=10).count() == 0


def test_language(spark):
    rows = [(d, t, g) for d, t, g, _ in corpus(1500)]
    more = [(9001, None, "en"), (9002, "", "en"), (9003, "12 -- !", "de"), (None, "der die das und", "de"), (9004, "der die das " * 60000, None), (9005, "x", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    got = langid.predict_language(docs, length=64, keep=["lang", "text"]).collect()
    assert len(got) == len(rows) + len(more)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (9001, 9002, 9003))
    assert by[9004]["lang_pred"] == "de" and by[None]["lang_pred"] == "de" and by[9005]["lang_pred"] in ("de", "en")
    held = [(by[d], g) for d, _, g in rows if by[d]["held_out"]]
    assert held and sum(r["lang_pred"] == g for r, g in held) > 0.97 * len(held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["kept"]["lang"] in ("en", "de", None) for r in got)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "der die", None)], "doc_id long, text string, lang string")
    assert langid.predict_language(docs).first()["lang_pred"] == "und"
    assert langid.predict_language(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [7, 64])
def test_windows_cover_every_byte(length):
    import numpy as np

    rng = random.Random(length)
    texts = [bytes(rng.choices(range(33, 120), k=rng.randint(0, 200))) for _ in range(30)]
    off = np.cumsum([0, *map(len, texts)])
    x, doc, used = langid.windows(np.frombuffer(b"".join(texts), np.uint8), off, length)
    for d, t in enumerate(texts):
        assert b"".join(bytes(row[:n]) for row, k, n in zip(x, doc, used, strict=True) if k == d) == t


def test_rare_and_many_languages(spark):
    rng = random.Random(8)
    # 1,200 languages, and one that holds most rows; 6 rows of another
    rows = [(k, "".join(rng.choices("abcdefgh", k=40)), f"l{k % 1200}") for k in range(1500 * 2)]
    rows += [(10_000 + k, " ".join(rng.choices(DE, k=20)), "de") for k in range(2000)] + [(50_000 + k, " ".join(rng.choices(["őz", "éjjel", "hétköznap"], k=20)), "hu") for k in range(8)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS kept")
    net = langid.train(docs, (5, 0), 3000, 32, 1, epochs=0)
    assert set(net.languages) == {g for d, _, g in rows if zlib.crc32(str(d).encode()) % 5 != 0}
    few = docs.filter("lang IN ('de', 'hu') AND doc_id >= 10000")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(few, max_rows=300, length=64).collect()}
    assert all(got[50_000 + k] == "hu" for k in range(8)) and sum(got[10_000 + k] == "de" for k in range(2000)) > 1950


def test_network_against_direct_convolution():
    import numpy as np

    net = langid.ByteNet(["a", "b", "c"], 12, filters=5, dim=3)
    rng = np.random.default_rng(1)
    for w in langid.WIDTHS:
        net.p[f"b{w}"] = rng.normal(0, 1, 5).astype(np.float32)
    x = rng.integers(0, 256, (7, 12)).astype(np.uint8)
    got = net.log_probs(x, net.tables(), block=3)
    for row, have in zip(x, got, strict=True):
        pooled = []
        for w in langid.WIDTHS:
            for f in range(5):
                best = 0.0
                for i in range(12 - w + 1):
                    z = net.p[f"b{w}"][f] + sum(float(net.p["e"][row[i + j]][d]) * float(net.p[f"k{w}"][j * 3 + d, f]) for j in range(w) for d in range(3))
                    best = max(best, z)
                pooled.append(best)
        logit = np.array(pooled) @ net.p["o"].astype(float) + net.p["c"]
        assert np.allclose(have, logit - np.log(np.exp(logit).sum()), atol=1e-4)


def test_ftrl_against_the_published_update():
    import math

    import numpy as np

    rng = random.Random(5)
    rows = []
    for _ in range(60):
        i = sorted(rng.sample(range(16), rng.randint(1, 6)))
        rows.append((np.array(i), np.array([rng.random() for _ in i]), rng.randint(0, 1)))
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    got, bias = quality.train_ftrl(rows, 4, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    share = sum(r[2] for r in rows) / len(rows)
    assert abs(bias - math.log(share / (1 - share))) < 1e-9
    z, n = [0.0] * 16, [0.0] * 16

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(3):
        for index, value, y in rows:
            w = {k: weight(k) for k in index.tolist()}
            p = 1 / (1 + math.exp(-(sum(w[k] * v for k, v in zip(index.tolist(), value.tolist(), strict=True)) + bias)))
            for k, v in zip(index.tolist(), value.tolist(), strict=True):
                g = (p - y) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    assert np.allclose(got, [weight(k) for k in range(16)], atol=1e-6)


def test_training_rows_are_bounded(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in rows] + [(0, rows[0][1])] * 30 + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, _, q in rows] * 2, "doc_id long, quality long")
    every = quality.training_rows(docs, labels, (3, 1), 1000, 14, 1 << 20)
    assert len(every) == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, *_ in rows)
    some = quality.training_rows(docs, labels, (3, 1), 1000, 14, 500)
    assert 0 < sum(len(r[0]) for r in some) <= 500
