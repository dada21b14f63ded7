"""Substring dedup: suffix automata of reference shards, streamed for matching statistics.

Windows of ``length`` consecutive words are routed to shards by content (see _segments), so a shard
holds every place of its windows. Equal windows also have equal keys there, so each key of a shard has
a reference of its own. Its segments come in the order of the least doc_id that has them. The suffix
automaton of all earlier documents' segments is the reference: a segment is streamed through it for its
matching statistics, and a window that ends where the match has ``length`` words or more has been seen in
a document with a smaller doc_id. Then the segment is added to the automaton. The first document has
nothing to be streamed through, the last one's segments need not be added. A segment that is equal to one
of a smaller doc_id is covered whole without streaming.

The automaton of one reference for all would have to be sent to every task; as the reference here is
the corpus itself, each shard's automata stay in its task and the documents' segments come to it.

Words are runs of non-space bytes, unchanged, compared by 64-bit hashes. Windows are judged on the
input. Nulls: a null text has no words; a null doc_id counts as smaller than all others and stays null.
Rows of one doc_id are one document: they don't cover each other. Repeated rows of different doc_ids
lose all windows but the first's. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm._bytes import SCAN, slices
from strata.llm._segments import Windows, all_covered, repeated
from strata.llm._shared import lean


class SuffixAutomaton:
    """The suffix automaton of a growing set of sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, q: int, x) -> int:
        """A state for the part of q that is one symbol longer than p."""
        clone = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for x in sequence:
            q = nxt[last].get(x)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, x)
                continue
            new = len(length)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0:
                q = nxt[p].setdefault(x, new)
                if q != new:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, x)
                    break
                p = link[p]
            last = new

    def matching(self, sequence) -> list[int]:
        """For each position the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for x in sequence:
            to = nxt[state].get(x)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(x)
            if to is None:
                n = 0
            else:
                state = to
                n += 1
            out.append(n)
        return out


def flag_shard(length: int):
    """Windows of each segment that a segment of its key and a smaller doc_id has too; rows come by key and doc_id."""

    def run(keys, least, counts, ns, contents) -> list[np.ndarray]:
        out = [np.zeros(n, bool) for n in ns]
        for _, group in groupby(range(len(keys)), keys.__getitem__):
            rows = list(group)
            first, last = least[rows[0]], least[rows[-1]]
            if first == last:
                continue
            automaton = SuffixAutomaton()
            waiting, at = [], first
            for k in rows:
                if least[k] != at:
                    for w in waiting:
                        automaton.add(w)
                    waiting, at = [], least[k]
                w = memoryview(contents[k]).cast("q").tolist()
                if at != first:
                    out[k] = np.array(automaton.matching(w)[length - 1 :]) >= length
                if at != last:
                    waiting.append(w)
        return out

    return run


def remove_seen(docs: DataFrame, length: int = 13, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, and the kept words on demand."""
    spec = Windows("words", length, min(4, length), within=False, shard_bytes=512 << 10)
    rows = repeated(docs, spec, flag_shard(length), "id > least")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
        for batch in batches:
            for part in slices(batch, "text", SCAN):
                out: list[tuple] = []
                ids, least, _, spans, text = part.columns
                # Splits where SPACE does.
                split = [t.split() for t in text.cast(pa.binary()).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(w) for w in split])))
                gone = all_covered(off, spans, length)
                stay = (~gone).view(np.uint8)
                for k, (id_, low, w) in enumerate(zip(ids.to_pylist(), least.to_pylist(), split, strict=True)):
                    n = len(w)
                    if id_ > low:
                        removed = n if n >= length else 0
                        kept = b"" if removed else b" ".join(w)
                    else:
                        mask = stay[off[k] : off[k + 1]]
                        removed = n - int(np.count_nonzero(mask))
                        kept = b" ".join(compress(w, mask.tobytes()) if removed else w)
                    out.append((None if id_ == -(2**63) else id_, n, removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return rows.mapInArrow(lean(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
