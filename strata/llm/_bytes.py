"""Vectorised scanning of UTF-8 text in Arrow batches: words, word hashes, rolling hashes.

Rolling hashes are 64-bit polynomials in an odd base over random values of the units, kept as differences
of prefix sums, so that the hash of any span costs two look-ups. They have families of collisions, so they
only say where a span is sent to, never that two spans are equal. Hashes of words are not linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words of more bytes are hashed one by one; masks that keep the first n bytes of eight.
LONG = 64
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)
#: Bytes scanned at once; powers of the base are kept for as many.
SCAN = 1 << 20
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (BASE, BASE_INV):
            p = np.full(SCAN + 1, base, U64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the n + 1 offsets. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, or a single row that has more."""
    if batch.num_rows == 0:
        return
    _, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and for each text the index of its first word (n + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    ink = ~SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = ink[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = False
    starts = np.flatnonzero(ink & ~before)
    after = before
    after[:-1] = ink[1:]
    after[-1] = False
    after[off[1:][off[1:] > 0] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; A-Z count as a-z if ``lower``.

    Each step is a bijection that isn't linear, so words of up to eight bytes never collide with others of
    their length, and no family of longer ones does so by its structure. Words over LONG bytes take xxh3.
    """
    size = ends - starts
    out = mix(size.astype(U64) + U64(1))
    if not len(starts):
        return out
    bytes_ = LOWER[buf] if lower else buf
    padded = np.concatenate((bytes_, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        x = eight[starts[live] + k] & KEEP[np.minimum(size[live] - k, 8)]
        out[live] = mix(out[live] * BASE + x)
    for w in np.flatnonzero(size > LONG).tolist():
        out[w] = xxhash.xxh3_64_intdigest(bytes_[starts[w] : ends[w]].tobytes())
    return out


def row_of(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the index of each text's first item (n + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
