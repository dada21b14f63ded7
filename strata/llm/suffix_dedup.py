"""Suffix-array dedup: remove every byte of a string of ``length`` bytes that also starts anywhere else.

Texts are taken as UTF-8. Windows are routed to independent shards by content (see _segments); a
shard's distinct segments are joined by a byte that UTF-8 never has and their suffixes are sorted by
external induced sorting, which carries the common-prefix values along (see induced). Runs of
suffixes that share ``length`` bytes are equal windows; a run whose segments stand for two or more
places is a repeat. Matches never cross a document, as segments lie inside one; a document's own
repeats count, overlapping ones too. Whole copies of a text are repeats of each other.

Strings are judged on the input: what is removed elsewhere doesn't matter.

Nulls: a null text is empty. A null doc_id is a document like others and stays null. Repeated rows are
separate documents. Texts under ``length`` bytes stay whole. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm import induced
from strata.llm._bytes import SCAN, slices, text_buffers
from strata.llm._segments import Windows, all_covered, repeated
from strata.llm._shared import lean

SEPARATOR = b"\xff"


def flag_shard(length: int):
    """Windows whose bytes stand in two or more places of the shard's segments."""

    def run(keys, least, counts, ns, contents) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contents])
        start = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        text = np.frombuffer(SEPARATOR.join([*contents, b""]), np.uint8)
        change = np.zeros(len(text), np.int64)
        change[start] = counts
        change[start + np.array(ns)] = np.negative(counts)  # a segment is longer than its windows are many
        places = np.cumsum(change)  # of the windows that start here
        order, prefix = induced.sort_suffixes(text, length)
        first = np.flatnonzero(prefix < length)
        times = np.add.reduceat(places[order], first) if len(first) else np.zeros(0, np.int64)
        repeat = np.zeros(len(text), bool)
        repeat[order] = np.repeat(times >= 2, np.diff(np.append(first, len(order))))
        return [repeat[at : at + n] & (places[at : at + n] > 0) for at, n in zip(start.tolist(), ns, strict=True)]

    return run


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes on demand."""
    spec = Windows("bytes", length, min(32, length), within=True, shard_bytes=2 << 20)
    rows = repeated(docs, spec, flag_shard(length), "count > 1")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
        for batch in batches:
            for part in slices(batch, "text", SCAN):
                ids, _, copies, spans, text = part.columns
                buf, off = text_buffers(text)
                n = np.diff(off)
                gone = all_covered(off, spans, length) | np.repeat((copies.to_numpy() > 1) & (n >= length), n)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                edge = off[:-1][n > 0]
                begin[edge] = gone[edge]
                removed, runs = (np.diff(np.concatenate(([0], np.cumsum(x)))[off]) for x in (gone, begin))
                left = np.concatenate(([0], np.cumsum(n - removed))).tolist()
                stay = buf[~gone].tobytes()
                kept = [stay[i:j] for i, j in pairwise(left)]
                id_ = ids.to_numpy()
                cols = [pa.array(id_, mask=id_ == -(2**63)), pa.array(n), pa.array(removed), pa.array(runs), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(kept, pa.binary())] * with_text], names)

    return rows.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
