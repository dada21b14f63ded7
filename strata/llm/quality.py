"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features of a text are its word unigrams and bigrams (A-Z as a-z) and the unigrams, bigrams and
trigrams of word shapes (kinds of first and last byte, length class, whether the word repeats the one
before), each hashed into one table of 2**bits weights; their values are shares of the text's words.
A score is the sparse dot product of shares and weights through the logistic function. The model has
a fixed size (2**bits floats) and goes to the executors inside the function; texts are scored whole,
a scan at a time.

Training takes a bounded sample: at most ``max_rows`` labelled rows, half of each label where there are
enough, in the order of a hash of doc_id, until they have ``max_features`` distinct features in all
(64 MB), so it is the same in every run. Nothing but the text is an input. The bias is the log-odds of
the sample, so a score is relative to it and not calibrated to how often labels come.

Nulls: a null text is empty; an empty text has no features and gets the score of the bias. A null
doc_id isn't held out (its remainder is null) and is never learnt from. Repeated rows are scored
each and learnt from once. Texts of any length are read whole. With an empty table or without labels of both kinds the bias is the share of label 1 (0.5
without any). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._bytes import U64, mix, row_of, slices, text_buffers, word_hashes, words
from strata.llm._shared import lean, staged, tune

KIND = np.full(256, 4, np.uint8)  # punctuation and control
KIND[0x61:0x7B] = 0
KIND[0x41:0x5B] = 1
KIND[0x30:0x3A] = 2
KIND[0x80:] = 3
SCALE = 32.0


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, table index) of every n-gram of every text."""
    starts, ends, first = words(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = row_of(first)
    w = word_hashes(buf, starts, ends, lower=True)
    same = np.zeros(len(w), np.uint8)
    same[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    length = np.minimum(np.log2(ends - starts).astype(np.uint8), 5)
    second = buf[np.minimum(starts + 1, ends - 1)]
    shape = mix(((((KIND[buf[starts]].astype(U64) * U64(5) + KIND[second]) * U64(256) + np.where(KIND[buf[ends - 1]] == 4, buf[ends - 1], KIND[buf[ends - 1]])) * U64(6) + length) * U64(2) + same) + U64(1))
    docs, index = [], []

    def gram(h: np.ndarray, n: int, salt: int) -> None:
        k = len(h) - n + 1
        if k <= 0:
            return
        x = h[:k] * U64(salt)
        for i in range(1, n):
            x = mix(x) + h[i : i + k]
        inside = doc[:k] == doc[n - 1 :]
        docs.append(doc[:k][inside])
        index.append((mix(x)[inside] >> U64(64 - bits)).astype(np.int64))

    gram(w, 1, 3)
    gram(w, 2, 5)
    for n, salt in ((1, 7), (2, 11), (3, 13)):
        gram(shape, n, salt)
    return np.concatenate(docs), np.concatenate(index)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) from (indices, values, label) rows, taken in the order of the list."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = 0.0
    labels = np.array([r[2] for r in rows], float)
    if len(labels):
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    if 0 < labels.mean() < 1 if len(labels) else False:
        for _ in range(epochs):
            for i, x, y in rows:
                w = weights(i)
                p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
                g = (p - y) * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
                n[i] += g * g
    return weights(slice(None)).astype(np.float32), bias


def training_rows(docs: DataFrame, labels: DataFrame, held_out_mod: tuple[int, int], max_rows: int, bits: int, max_features: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of the rows learnt from: at most ``max_rows``, and ``max_features`` of them in all, made on the executors."""
    mod, out = held_out_mod
    usable = labels.filter(labels["quality"].isin(0, 1) & (F.crc32(labels["doc_id"].cast("string")) % mod != out)).select(labels["doc_id"].alias("label_id"), labels["quality"].cast("int").alias("label"))
    usable = usable.groupBy("label_id").agg(F.max("label").alias("label")).withColumn("key", F.md5(F.concat(F.col("label_id").cast("string"), F.lit(":quality"))))
    top = usable.filter("label = 0").orderBy("key", "label_id").limit(max_rows // 2).unionByName(usable.filter("label = 1").orderBy("key", "label_id").limit(max_rows // 2))
    picked = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(top), F.col("doc_id") == F.col("label_id")).select("key", "label", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                buf, off = text_buffers(part.column(2))
                doc, index = features(buf, off, bits)
                starts, _, first = words(buf, off)
                key, count = np.unique(doc << bits | index, return_counts=True)
                at = np.searchsorted(key >> bits, np.arange(part.num_rows + 1))
                size = np.maximum(np.diff(first), 1)
                idx = (key & ((1 << bits) - 1)).astype("<i4")
                val = (count / size[key >> bits] * SCALE).astype("<f4")
                both = [idx[a:b].tobytes() + val[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.binary())], ["key", "label", "row"])

    # Rows that repeat a doc_id count once.
    made = staged(picked.mapInArrow(lean(sparse), "key string, label int, row binary").groupBy("key", "label").agg(F.min("row").alias("row")), "training")
    so_far = F.sum(F.length("row") / 8).over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most max_rows rows
    taken = made.select("key", so_far.alias("n")).filter(F.col("n") <= max_features).select(F.col("key").alias("k"))
    got = made.join(F.broadcast(taken), F.col("key") == F.col("k")).select("key", "label", "row").collect()
    got.sort(key=lambda r: r["key"])
    out_rows = []
    for r in got:
        n = len(r["row"]) // 2
        out_rows.append((np.frombuffer(r["row"][:n], "<i4").astype(np.int64), np.frombuffer(r["row"][n:], "<f4").astype(np.float64), r["label"]))
    return out_rows


def score_quality(docs: DataFrame, labels: DataFrame, held_out_mod: tuple[int, int] = (3, 1), max_rows: int = 6000, bits: int = 18, max_features: int = 1 << 23) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    tune(docs.sparkSession)
    weights, bias = train_ftrl(training_rows(docs, labels, held_out_mod, max_rows, bits, max_features), bits)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                buf, off = text_buffers(part.column(2))
                doc, index = features(buf, off, bits)
                _, _, first = words(buf, off)
                dot = np.bincount(doc, weights[index], part.num_rows) / np.maximum(np.diff(first), 1) * SCALE + bias
                p = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    mod, out = held_out_mod
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.crc32(docs["doc_id"].cast("string")) % mod == out, F.lit(False)).alias("held_out"), docs["text"].alias("text"))
    return rows.mapInArrow(lean(scores), "doc_id long, held_out boolean, score double, predicted int")
