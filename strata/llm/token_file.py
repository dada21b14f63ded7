"""Token ids in a binary file of fixed bit width.

A file is a Parquet data set that any Hadoop file system can hold; each row is one block of whole
documents. The payload of a block is, little-endian,

    magic "TKB1" | width u32 | n_docs u64 | n_ids u64 | first_doc i64 | doc lengths u64[n_docs] |
    doc ids i64[n_docs] | offsets u64[ceil(n_ids / STRIDE) + 1] | packed ids

``width`` is the least number of bits that holds every id of the vocabulary. Ids are packed from the
lowest bit, and each run of STRIDE = 4,096 ids starts on a byte; ``offsets`` has where, so any id is
read without what stands before it. Rows carry (first_doc, last_doc, n_docs, n_ids), so a reader
prunes blocks by doc_id from the Parquet statistics.

Blocks are in ascending doc_id order. Encoding uses the model of the tokenizers library. Words made
of Latin letters, digits and ASCII punctuation, whose normalisation and pre-tokenisation are known, are
lower-cased and cut into runs in numpy; each distinct run of a piece of text is looked up once, in a bounded
cache, and new ones go to the library's BPE model directly. Every other word is a run that the library
encodes whole. Both give the ids of encoding the whole text, as the vocabulary never joins across white
space; a text that holds an added token's string is encoded whole. A vocabulary for which probes show
anything else (one that keeps spaces, say) gets every text encoded whole.

Nulls: a null text is empty and has the end id only; rows without doc_id come first, under the id
-2**63. Rows of one doc_id are kept, ordered by text, and any number of them is spread over ranges of
texts. An empty table gives an empty file and result. Other columns are not
looked at.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._bytes import LOWER, SPACE, slices, text_buffers
from strata.llm._shared import cached, lean, staged, tune

STRIDE = 4096
NULL_ID = -(2**63)
MAGIC = b"TKB1"
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Kinds of bytes. Latin letters whose lower case is one letter and which composition leaves alone are plain, those of two bytes too.
WHITE, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[SPACE] = WHITE
KIND[0x21:0x7F] = MARK
KIND[0x27] = ODD
KIND[0x30:0x3A] = DIGIT
KIND[0x41:0x5B] = KIND[0x61:0x7B] = LETTER
LATIN_LEAD = 0xC3
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
#: Runs that pre-tokenisation leaves whole: letters, a digit, punctuation.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def width_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def _chunk_bytes(width: int) -> int:
    return (STRIDE * width + 7) // 8


def pack(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, packed bytes) of the ids."""
    n = len(ids)
    chunks = -(-n // STRIDE)
    offsets = np.minimum(np.arange(chunks + 1, dtype=np.uint64) * np.uint64(_chunk_bytes(width)), np.uint64(((n % STRIDE or STRIDE) * width + 7) // 8 + max(0, chunks - 1) * _chunk_bytes(width) if n else 0))
    if width in (8, 16, 32):
        return offsets, ids.astype(f"<u{width // 8}").view(np.uint8)
    out = []
    for k in range(0, n, STRIDE):
        part = ids[k : k + STRIDE].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return offsets, np.concatenate(out) if out else np.zeros(0, np.uint8)


def unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n ids of ``packed``, which starts at a chunk."""
    if width in (8, 16, 32):
        return packed[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    out = np.empty(n, np.uint32)
    weights = (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]
    for k in range(0, n, STRIDE):
        m = min(STRIDE, n - k)
        at = k // STRIDE * _chunk_bytes(width)
        bits = np.unpackbits(packed[at : at + (m * width + 7) // 8], bitorder="little", count=m * width)
        out[k : k + m] = (bits.reshape(m, width) * weights).sum(1)
    return out


def write_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    offsets, packed = pack(ids, width)
    head = MAGIC + struct.pack("<IQQq", width, len(doc_ids), len(ids), doc_ids[0])
    return b"".join((head, np.array(lengths, "<u8").tobytes(), np.array(doc_ids, "<i8").tobytes(), offsets.astype("<u8").tobytes(), packed.tobytes()))


class Block:
    """A reader of one block."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.width, n, self.n_ids, _ = struct.unpack_from("<IQQq", payload, 4)
        at = 4 + struct.calcsize("<IQQq")
        self.lengths = np.frombuffer(payload, "<u8", n, at).astype(np.int64)
        self.doc_ids = np.frombuffer(payload, "<i8", n, at + 8 * n)
        at += 16 * n
        chunks = -(-self.n_ids // STRIDE)
        self.offsets = np.frombuffer(payload, "<u8", chunks + 1, at).astype(np.int64)
        self.packed = np.frombuffer(payload, np.uint8, offset=at + 8 * (chunks + 1))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``end``, read from the chunk of the first one on."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.zeros(0, np.uint32)
        first = start // STRIDE
        got = unpack(self.packed[self.offsets[first] :], self.width, end - first * STRIDE)
        return got[start - first * STRIDE :]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """run -> packed little-endian ids; new runs are looked up in the library."""

    MOST = 500_000
    #: Bytes of text scanned at once; a piece ends at white space.
    PIECE = 1 << 20

    def __init__(self, path: str, dtype: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.dtype = dtype
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.direct = self._is_direct()
        self.clear()

    def _is_direct(self) -> bool:
        """Whether the library treats plain words as expected: lower-cased, cut into letters, digits and punctuation, never joined across white space."""
        if array("I", [1]).tobytes() != np.array([1], self.dtype).tobytes():
            return False
        plain = [c for c in map(chr, range(0x100)) if PLAIN.fullmatch(c.encode())]
        probe = ["Abc,", "Él!!", "(a)", "ABCdef.", "a1b22,c", "x@y.z-10", "It's", "日本,", "e\u0301", *plain, *(f"the{c}{c}The" for c in plain), *(f".{c}.{c}" for c in plain)]
        text = "  ".join(probe) + " \n\tx "
        return self._runs(*text_buffers(pa.array([text])))[0].tobytes() == self._whole(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        if PLAIN.fullmatch(run):
            p = run.decode("ascii") if run.isascii() else run.decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(p)]).tobytes()
        else:
            got = self._whole(run.decode())
        if len(run) <= 64:
            self[run] = got
        return got

    def _piece(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each run, ids before each run and after the last, ids) of whole words; ``texts`` has where texts start."""
        kind, low = KIND[raw], LOWER[raw]
        at = np.flatnonzero(raw[:-1] == LATIN_LEAD)
        at = at[LATIN[raw[at + 1]]] + 1
        kind[at - 1] = kind[at] = LETTER
        low[at[raw[at] < 0x9F]] += 0x20
        odd = kind == ODD
        odd[1:] &= kind[:-1] != ODD
        odd[texts] = kind[texts] == ODD
        odd = np.flatnonzero(odd)
        if len(odd):
            gaps, w = np.flatnonzero(kind == WHITE), np.searchsorted(texts, odd, "right")
            left, right = (np.concatenate(([0], x, [len(raw)])) for x in (gaps + 1, texts))
            k = np.searchsorted(gaps, odd)
            starts = np.maximum(left[k], right[w])
            ends = np.minimum(np.append(gaps, len(raw))[k], right[w + 1])
            one = np.diff(starts, prepend=-1) > 0
            starts, n = starts[one], (ends - starts)[one]
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            kind[at], low[at] = ODD, raw[at]
        cut = kind == DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[0] = True
        cut[texts] = True
        starts = np.flatnonzero(cut)
        n = np.diff(starts, append=len(raw))
        ink = kind[starts] != WHITE
        starts, n = starts[ink], n[ink]
        offsets = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=offsets[1:])
        runs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(low[kind != WHITE])]).dictionary_encode()
        known = list(map(self.__getitem__, runs.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = runs.indices.to_numpy()
        n = size[which]
        before = np.concatenate(([0], np.cumsum(n)))
        return starts, before, np.frombuffer(b"".join(known), self.dtype)[np.repeat((np.cumsum(size) - size)[which] - before[:-1], n) + np.arange(before[-1])]

    def _runs(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of plain and other words, run by run."""
        at = np.zeros(len(off), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, self.dtype)]
        a = held = 0
        while a < len(buf):
            gap = GAP.search(buf, a + self.PIECE)
            b = gap.end() if gap else len(buf)
            first, last = np.searchsorted(off, (a, b))
            inside = off[first:last] - a
            starts, before, ids = self._piece(buf[a:b], inside)
            at[first:last] = held + before[np.searchsorted(starts, inside)]
            parts.append(ids)
            a, held = b, held + len(ids)
        at[np.searchsorted(off, len(buf)) :] = held
        ids = np.concatenate(parts)
        return [ids[p:q] for p, q in itertools.pairwise(at.tolist())]

    def rows(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        buf, off = text_buffers(texts)
        every = buf.tobytes()
        spans = list(itertools.pairwise(off.tolist()))
        whole = [k for k, (a, b) in enumerate(spans) if any(x in every[a:b] for x in self.added)] if any(x in every for x in self.added) else []
        if not self.direct:
            whole = list(range(len(spans)))
        got = {k: np.frombuffer(self._whole(every[slice(*spans[k])].decode()), self.dtype) for k in whole}
        if len(got) == len(spans):
            return list(got.values())
        if got:
            buf = buf.copy()
            for k in got:
                buf[slice(*spans[k])] = 0x20
        return [got.get(k, ids) for k, ids in enumerate(self._runs(buf, off))]

    def encode(self, text: str) -> bytes:
        return self.rows(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str, dtype: str) -> WordEncoder:
    return cached((WordEncoder, path, dtype), lambda: WordEncoder(path, dtype))


def write(docs: DataFrame, vocabulary: str, end_id: int = 1, block_ids: int = 1 << 18, name: str = "tokens") -> DataFrame:
    """Encode all documents, write the blocks in ascending doc_id order into the shared folder, and return them as read back."""
    tune(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, "<u4")
        width = width_for(max(enc.size, end_id + 1))
        end = np.array([end_id], "<u4")
        part, before, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            payload = write_block(ids, lengths, np.concatenate(codes), width)
            row = [part, before, ids[0], ids[-1], len(ids), held, payload]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 6 + [pa.binary()], strict=True)], ["part", "part_start", "first_doc", "last_doc", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for rows in slices(batch, "text", 8 << 20):
                for doc, got in zip(rows.column(0).to_pylist(), enc.rows(rows.column(1)), strict=True):
                    ids.append(doc)
                    lengths.append(len(got) + 1)
                    codes += got, end
                    held += len(got) + 1
                    if held >= block_ids:
                        yield full()
                        before, held = before + held, 0
                        ids, lengths, codes = [], [], []
        if ids:
            yield full()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs["text"].alias("text"))
    # Bounds of ranges need little of a text; the order is that of whole texts.
    ordered = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 200)).sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(lean(blocks), "part long, part_start long, first_doc long, last_doc long, n_docs long, n_ids long, payload binary"), name)


def read(blocks: DataFrame) -> DataFrame:
    """One row a document from the blocks: doc_id, start, n_tokens, ids_crc32, bits (width of an id).

    A block knows how many ids its part has before it; the parts' totals are summed here, one row a part.
    """
    tune(blocks.sparkSession)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                block = Block(payload.as_py())
                ids = block.ids().astype("<u4")
                at = np.concatenate(([0], np.cumsum(block.lengths)))
                m = len(block.doc_ids)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, part.as_py())), pa.array(block.doc_ids), pa.array(at[:-1] + start.as_py()), pa.array(block.lengths), pa.array(crc, pa.int64()), pa.array(np.full(m, block.width, np.int32))],
                    ["part", "doc_id", "inside", "n_tokens", "ids_crc32", "bits"],
                )

    got = blocks.select("part", "part_start", "payload").mapInArrow(lean(documents), "part long, doc_id long, inside long, n_tokens long, ids_crc32 long, bits int")
    return got.join(parts, F.col("part") == F.col("p")).select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "bits")
