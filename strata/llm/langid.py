"""Language identification by a byte convolutional network, trained in numpy.

The network looks at a window of ``length`` bytes: bytes are embedded, filters of several widths run
over them, each filter keeps its maximum over the window (ReLU), and a softmax layer gives the
languages. A text is cut into consecutive windows, whole; the mean log-probability, weighted by the
bytes of the windows, decides. For scoring, embedding and filters are multiplied out into one table
of 256 rows for each filter width and offset, so a window costs look-ups and additions.

Training takes a bounded sample: ``per_text`` windows, evenly spread, of each of at most ``max_rows``
labelled rows, chosen by a hash of doc_id, as many of each language as there are, or its fair share. So
a rare language is learnt, and there may be as many languages as ``max_rows``. The model has a few
thousand floats, and some fifty for each language, and goes to the executors inside the function. Only
text and, for rows learnt from, lang are looked at.

Nulls and texts without a letter are ``und`` with score 0; so is every text where nothing could be
learnt (no labelled row, an empty table). A null doc_id isn't held out and is never learnt from.
Repeated rows are predicted each and learnt from once. Texts of any length are read whole, a slice of
rows at a time. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._bytes import slices, text_buffers
from strata.llm._shared import lean, tune

LETTER = re.compile(r"[^\W\d_]")
WIDTHS = (2, 3, 4)


def windows(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each window, the last ones padded with spaces; its text; bytes of text in it)."""
    sizes = np.diff(off)
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), count)
    if not len(doc):
        return np.zeros((0, length), np.uint8), doc, doc
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][doc] + nth * length
    used = np.minimum(length, off[1:][doc] - start)
    padded = np.concatenate((buf, np.full(length, 0x20, np.uint8)))
    x = padded[start[:, None] + np.arange(length)]
    x[np.arange(length) >= used[:, None]] = 0x20
    return x, doc, used


class ByteNet:
    def __init__(self, languages: list[str], length: int, filters: int = 16, dim: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.length, self.filters = languages, length, filters
        self.p = {"e": rng.normal(0, 0.5, (256, dim))} | {f"k{w}": rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters)) for w in WIDTHS}
        self.p |= {f"b{w}": np.zeros(filters) for w in WIDTHS} | {"o": rng.normal(0, 0.2, (filters * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 4e-3, seed: int = 6) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, dim = 0, self.p["e"].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                n, p = len(xb), self.p
                emb = p["e"][xb]
                pooled, kept = [], []
                for w in WIDTHS:
                    k = self.length - w + 1
                    cols = np.concatenate([emb[:, i : i + k] for i in range(w)], 2)
                    z = cols.reshape(n * k, -1) @ p[f"k{w}"]
                    z = z.reshape(n, k, -1) + p[f"b{w}"]
                    best = z.argmax(1)
                    top = np.take_along_axis(z, best[:, None], 1)[:, 0]
                    pooled.append(np.maximum(top, 0))
                    kept.append((cols, best, top > 0))
                hidden = np.concatenate(pooled, 1)
                logit = hidden @ p["o"] + p["c"]
                prob = np.exp(logit - logit.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                prob[np.arange(n), yb] -= 1
                prob /= n
                grad = {"o": hidden.T @ prob, "c": prob.sum(0), "e": np.zeros_like(p["e"])}
                back = prob @ p["o"].T
                for i, (w, (cols, best, on)) in enumerate(zip(WIDTHS, kept, strict=True)):
                    d = back[:, i * self.filters : (i + 1) * self.filters] * on
                    rows = cols[np.arange(n)[:, None], best]
                    grad[f"k{w}"] = np.einsum("nfd,nf->df", rows, d)
                    grad[f"b{w}"] = d.sum(0)
                    into = d[:, :, None] * p[f"k{w}"].T[None]
                    at_bytes = xb[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]
                    np.add.at(grad["e"], at_bytes.ravel(), into.reshape(n, self.filters, w, dim).reshape(-1, dim))
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        dim = self.p["e"].shape[1]
        return [(np.ascontiguousarray(np.stack([self.p["e"] @ self.p[f"k{w}"][i * dim : (i + 1) * dim] for i in range(w)])), self.p[f"b{w}"]) for w in WIDTHS]

    def log_probs(self, x: np.ndarray, tables: list, block: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), block):
            xb = x[at : at + block]
            pooled = []
            for w, (table, bias) in zip(WIDTHS, tables, strict=True):
                k = self.length - w + 1
                z = np.take(table[0], xb[:, :k], 0)
                for i in range(1, w):
                    z += np.take(table[i], xb[:, i : i + k], 0)
                pooled.append(np.maximum(z.max(1) + bias, 0))
            logit = np.concatenate(pooled, 1) @ self.p["o"] + self.p["c"]
            logit -= logit.max(1, keepdims=True)
            out[at : at + block] = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return out


def train(docs: DataFrame, held_out_mod: tuple[int, int], max_rows: int, length: int, per_text: int, epochs: int = 4) -> ByteNet | None:
    """A network from windows of the labelled rows; the same rows give the same network.

    A language's rows are dealt by a hash to ``max_rows`` buckets, each of which keeps one, so counting is
    pre-aggregated. Rows are then taken in turns, the first of every language, the second, and so on.
    """
    mod, out = held_out_mod
    usable = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull() & (F.crc32(docs["doc_id"].cast("string")) % mod != out))
    key = F.xxhash64(docs["doc_id"].cast("string"), F.lit("lang"))
    one = usable.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), key.alias("key")).groupBy("lang", F.pmod("key", F.lit(max_rows)).alias("bucket")).agg(F.min_by("doc_id", "key").alias("doc_id"), F.min("key").alias("key"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    top = one.withColumn("turn", turn).orderBy("turn", "key", "lang").limit(max_rows).select("doc_id", "lang", "key")
    rows = docs.select(docs["doc_id"].alias("id"), docs["lang"].alias("known"), docs["text"].alias("text")).join(F.broadcast(top), (F.col("id") == F.col("doc_id")) & (F.col("known") == F.col("lang"))).select("key", "lang", "text")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, found = [], [], []
            for part in slices(batch, "text"):
                buf, off = text_buffers(part.column(2))
                x, doc, used = windows(buf, off, length)
                for r, (k, lang) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    own = np.flatnonzero((doc == r) & (used >= min(8, length)))
                    if len(own):
                        spread = np.linspace(0, len(own) - 1, min(per_text, len(own))).astype(int)
                        keys.append(k), langs.append(lang), found.append(x[own[spread]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["key", "lang", "x"])

    # Rows that repeat a doc_id count once.
    got = sorted(tuple(r) for r in rows.mapInArrow(lean(some), "key long, lang string, x binary").groupBy("key", "lang").agg(F.min("x").alias("x")).collect())
    languages = sorted({r[1] for r in got})
    if not languages:
        return None
    net = ByteNet(languages, length)
    place = {lang: k for k, lang in enumerate(languages)}
    x = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, length)
    net.fit(x, np.repeat([place[r[1]] for r in got], [len(r[2]) // length for r in got]), epochs)
    return net


def predict_language(docs: DataFrame, held_out_mod: tuple[int, int] = (5, 0), max_rows: int = 3000, length: int = 192, per_text: int = 3, keep: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, and a struct ``kept`` of the columns in ``keep``."""
    tune(docs.sparkSession)
    net = train(docs, held_out_mod, max_rows, length, per_text)
    tables = net.tables() if net else []

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column(2)
                letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if net and letters.any():
                    buf, off = text_buffers(texts)
                    x, doc, used = windows(buf, off, length)
                    logp = net.log_probs(x, tables) * used[:, None]
                    mean = np.stack([np.bincount(doc, logp[:, k], part.num_rows) for k in range(len(net.languages))], 1) / np.maximum(np.diff(off), 1)[:, None]
                    prob = np.exp(mean - mean.max(1, keepdims=True))
                    prob /= prob.sum(1, keepdims=True)
                    best = prob.argmax(1)
                    lang[letters] = np.array(net.languages, object)[best][letters]
                    score[letters] = prob[np.arange(len(best)), best][letters]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), *(part.column(k) for k in range(3, part.num_columns))], ["doc_id", "held_out", "lang_pred", "score", *(["kept"] if keep else [])])

    mod, out = held_out_mod
    kept = [F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.crc32(docs["doc_id"].cast("string")) % mod == out, F.lit(False)).alias("held_out"), docs["text"].alias("text"), *kept)
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (f", kept {rows.schema['kept'].dataType.simpleString()}" if keep else "")
    return rows.mapInArrow(lean(predictions), schema)
