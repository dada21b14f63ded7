"""Finding repeated windows of a corpus in independent shards.

A window is ``length`` consecutive units (bytes or words) of a text. Its anchor is the least hash of
the k-grams inside it, so equal windows have equal anchors at equal offsets: every window belongs to
one anchor, wherever it stands. Neighbouring windows with one anchor position form a segment. Thus

1. the anchors of each text are written once; those that occur in one text only (or, if repeats inside a
   text count, once) hold no repeat and are dropped by a count with partial aggregation;
2. texts are fetched once for their other anchors' segments; segments of equal content are merged before
   they are shuffled to the shard of their anchor (128-bit hashes name them from then on); and
3. a kernel compares the segments of a shard exactly and flags windows.

An anchor with more than HOT occurrences gets its segments cut further, by the least hash of a window
other than the anchor's own: equal windows still meet, and those that have the anchor from a passage
but its surroundings from elsewhere spread over the shards. Exact copies of a text are one text from the start.

Neither bounds a key: in a passage that many texts share, windows that reach out of it have their
anchors in it. So a key with more than KEY_BYTES of distinct segments is cut again: its segments are
cut into blocks of windows by the place of the anchor in the window, and a block's new key is the hash
of the units that all its windows hold. Equal windows have equal places and equal units, so they still
meet; blocks with surroundings of their own part. Keys that are still too large are cut into single
windows, which merge into one row each. What is found out of the parts is put together for the merged
segment, so texts have no more segments than before. The number of shards follows the bytes of merged
segments, so a shard's size is bounded at every size of input.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._bytes import BYTE, SCAN, U64, mix, powers, row_of, signed, slices, text_buffers, word_hashes, words
from strata.llm._shared import discard, lean, staged, tune

HOT = 4096
KEY_BYTES = 256 << 10
#: Segments of a task, which takes its shards one after another.
TASK_BYTES = 4 << 20
MASK = U64((1 << 24) - 1)


@dataclass(frozen=True)
class Windows:
    """What a window is: ``unit`` "bytes" or "words", ``length`` units, anchored by grams of ``k`` units."""

    unit: str
    length: int
    k: int
    within: bool  # whether repeats inside one text count
    shard_bytes: int


def pieces(batch: pa.RecordBatch, spec: Windows) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, unit hashes, unit contents, offsets of the texts, unit index of the first) for bounded parts of a batch."""
    for part in slices(batch, "text", SCAN):
        buf, off = text_buffers(part.column(part.schema.get_field_index("text")))
        if spec.unit == "bytes":
            hashes, content = None, buf
        else:
            starts, ends, off = words(buf, off)
            hashes = content = word_hashes(buf, starts, ends)
        n = len(content)
        for at in range(0, max(n, 1), SCAN - spec.length + 1):
            c = content[at : at + SCAN]
            h = BYTE[c] if hashes is None else c
            yield part, h, c, np.clip(off - at, 0, len(c)), at
            if at + SCAN >= n:
                break


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    return key


def split_hot(gram: np.ndarray, first: int, n: int, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of the parts of a hot segment: cut by the least gram that isn't the anchor."""
    width = spec.length - spec.k + 1
    g = gram[first : first + n + width - 1]
    key = (g & ~MASK) | np.arange(len(g), dtype=U64)
    own = _sliding_min(key, width)[0] & MASK
    anchor = g[int(own)]
    key[g == anchor] = ~U64(0)
    least = _sliding_min(key, width)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    second = np.where(least[starts] == ~U64(0), anchor, g[np.minimum(least[starts] & MASK, U64(len(g) - 1)).astype(np.int64)])
    return mix(second * U64(31) + anchor), first + starts, np.diff(np.append(starts, n))


def segments(h: np.ndarray, off: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """(anchor, text, first window, windows) of each segment, the prefix sums that hash any span, and all grams."""
    n, size = len(h), spec.length
    pow_, inv = powers()
    c = np.zeros(n + 1, U64)
    np.cumsum(h * pow_[:n], out=c[1:])
    none = np.zeros(0, np.int64)
    if n < size:
        return none.astype(U64), none, none, none, c, none.astype(U64)
    m = n - spec.k + 1
    gram = mix((c[spec.k :] - c[:m]) * inv[:m])
    key = (gram & ~MASK) | np.arange(m, dtype=U64)
    key = _sliding_min(key, size - spec.k + 1)
    at = (key & MASK).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int32)
    fits = np.diff(off) >= size
    np.add.at(edge, off[:-1][fits], 1)
    np.add.at(edge, off[1:][fits] - size + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = at[1:] != at[:-1]
    before = np.zeros(len(at), bool)
    before[1:] = valid[:-1]
    first = np.flatnonzero(valid & (change[:-1] | ~before))
    after = np.zeros(len(at), bool)
    after[:-1] = valid[1:]
    last = np.flatnonzero(valid & (change[1:] | ~after))
    return gram[at[first]], np.searchsorted(off, first, "right") - 1, first, last - first + 1, c, gram


def _pairs(spec: Windows):
    """(anchor, id, tid, n) once for each text and anchor, which it has n times."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {"a": [], "t": []}
            seen, row = None, 0
            for part, h, _, off, _ in pieces(batch, spec):
                if seen is not None and part is not seen:
                    row += seen.num_rows
                seen = part
                anchor, text, *_ = segments(h, off, spec)
                found["a"].append(anchor)
                found["t"].append(text + row)
            if seen is None:
                continue
            anchor, text = np.concatenate(found["a"]), np.concatenate(found["t"])
            order = np.lexsort((anchor, text))
            anchor, text = anchor[order], text[order]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            rows = pa.array(text[at])
            each = pa.array(np.diff(np.append(at, len(anchor))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[at])), batch.column(0).take(rows), batch.column(1).take(rows), each], ["anchor", "id", "tid", "n"])

    return find


def _contents(spec: Windows):
    """Segments of the wanted anchors: (key, seg, id, tid, start, n, content); those of hot anchors in parts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seg", "id", "tid", "start", "n", "content"]
        for batch in batches:
            for part, h, content, off, base in pieces(batch, spec):
                anchor, text, first, n, c, gram = segments(h, off, spec)
                if not len(anchor):
                    continue
                anchor = signed(anchor)
                # An anchor that is wanted or hot in one text is so in all.
                keep = np.isin(anchor, part.column(2).flatten().to_numpy())
                much = part.column(3).flatten().to_numpy()
                hot = keep & np.isin(anchor, much) if len(much) else np.zeros(len(anchor), bool)
                cold = keep & ~hot
                t, f, k, key = text[cold], first[cold], n[cold], anchor[cold]
                cut = np.flatnonzero(hot)
                if len(cut):
                    parts = [split_hot(gram, int(first[x]), int(n[x]), spec) for x in cut]
                    each = [len(x[0]) for x in parts]
                    t = np.concatenate((t, np.repeat(text[cut], each)))
                    f, k, key = (np.concatenate((old, *[x[at] for x in parts])) for old, at in ((f, 1), (k, 2), (key.view(U64), 0)))
                    key = signed(key)
                if not len(t):
                    continue
                end = f + k + spec.length - 1
                rows = pa.array(t)
                for x in range(0, len(t), 20_000):
                    y = slice(x, x + 20_000)
                    bodies = [content[i:j].tobytes() for i, j in zip(f[y].tolist(), end[y].tolist(), strict=True)]
                    seg = pa.array(map(xxhash.xxh3_128_digest, bodies), pa.binary())
                    # offsets are those of the piece; ``start`` counts from the start of the text
                    start = f[y] - off[t[y]] + (base if part.num_rows == 1 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[y]), seg, part.column(0).take(rows[y]), part.column(1).take(rows[y]), pa.array(start), pa.array(k[y].astype(np.int32)), pa.array(bodies, pa.binary())], names)

    return find


def recut(content: bytes, n: int, width: int, spec: Windows) -> tuple[list[tuple[int, int]], list[bytes], list[bytes]]:
    """((first window, windows), content, what all windows of its whole block share) of the blocks of a segment."""
    unit = np.frombuffer(content, np.uint8 if spec.unit == "bytes" else np.int64)
    h = BYTE[unit] if spec.unit == "bytes" else unit.view(U64)
    size = unit.itemsize
    anchor = 0
    if width > 1:
        pow_, inv = powers()
        c = np.zeros(spec.length + 1, U64)
        np.cumsum(h[: spec.length] * pow_[: spec.length], out=c[1:])
        m = spec.length - spec.k + 1
        gram = mix((c[spec.k :] - c[:m]) * inv[:m])
        anchor = int(np.argmin(gram & ~MASK))  # the first of the least ones, as in segments()
    block = (anchor - np.arange(n)) // width
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    each = np.diff(np.append(first, n))
    lo = anchor - block[first] * width  # the block's last window
    body = [content[a * size : (a + k - 1 + spec.length) * size] for a, k in zip(first.tolist(), each.tolist(), strict=True)]
    core = [content[x * size : (x - width + 1 + spec.length) * size] for x in lo.tolist()]
    return list(zip(first.tolist(), each.tolist(), strict=True)), body, core


def _cut(width: int, spec: Windows):
    """The blocks of merged segments: (key, seg, least, count, n) of the segment, (first, pkey, pseg, pn, content) of the block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "seg", "least", "count", "n", "first", "pkey", "pseg", "pn", "content"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[tuple] = []
                for key, seg, least, count, n, content in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    for (a, k), body, core in zip(*recut(content, n, width, spec), strict=True):
                        out.append((key, seg, least, count, n, a, xxhash.xxh3_64_intdigest(core, seed=width), xxhash.xxh3_128_digest(body), k, body))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(c, U64))) if k == 6 else pa.array(c, pa.binary() if k in (1, 7, 9) else pa.int64()) for k, c in enumerate(cols)], names)

    return cut


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The flags of a segment from those of its blocks."""
    for batch in batches:
        bits = []
        for n, parts in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            b = np.zeros(n, bool)
            for p in parts:
                if p["bits"] != b"":
                    b[p["first"] : p["first"] + p["pn"]] = True if p["bits"] is None else np.unpackbits(np.frombuffer(p["bits"], np.uint8), bitorder="little", count=p["pn"]).astype(bool)
            bits.append(np.packbits(b, bitorder="little").tobytes() if b.any() else b"")
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(bits, pa.binary())], ["key", "seg", "least", "count", "bits"])


def divide(merged: DataFrame, spec: Windows) -> tuple[DataFrame, list[DataFrame]]:
    """(segments and blocks, no key of which has more than KEY_BYTES but by single windows; the blocks of each cut)."""
    done, levels = None, []
    for width in (math.isqrt(spec.length - spec.k + 1), 1):
        # At most one key for each KEY_BYTES of segments.
        big = staged(merged.groupBy("key").agg(F.sum(F.length("content")).alias("size"), F.max("n").alias("most")).filter((F.col("size") > KEY_BYTES) & (F.col("most") > 1)).select(F.col("key").alias("big")), "big")
        if big.isEmpty():
            break
        heavy = merged.join(F.broadcast(big), F.col("key") == F.col("big"), "left_semi").select("key", "seg", "least", "count", "n", "content")
        light = merged.join(F.broadcast(big), F.col("key") == F.col("big"), "left_anti")
        done = light if done is None else done.unionByName(light)
        blocks = staged(heavy.mapInArrow(lean(_cut(width, spec)), "key long, seg binary, least long, count long, n long, first long, pkey long, pseg binary, pn long, content binary"), "blocks")
        levels.append(blocks.drop("content"))
        merged = blocks.groupBy(F.col("pkey").alias("key"), F.col("pseg").alias("seg"), "content").agg(F.min("least").alias("least"), F.sum("count").alias("count"), F.max("pn").cast("int").alias("n"))
        merged = staged(merged.select("key", "seg", "least", "count", "n", "content"), "divided")
    return (merged if done is None else done.unionByName(merged)), levels


def gathered(flags: DataFrame, levels: list[DataFrame], rule: str) -> DataFrame:
    """Flags of all segments, with those that were cut."""
    for blocks in reversed(levels):
        of = flags.select(F.col("key").alias("k"), F.col("seg").alias("s"), F.col("least").alias("low"), F.col("count").alias("times"), "bits")
        hit = blocks.join(of, (F.col("pkey") == F.col("k")) & (F.col("pseg") == F.col("s")), "left")
        # The rule for the segment's least id and a block that has been seen as often as all segments with it.
        every = hit.select(F.struct("key", "seg", "least", "count", "n").alias("of"), "first", "pn", "bits", F.col("least").alias("id"), F.col("low").alias("least"), F.col("times").alias("count")).withColumn("every", F.coalesce(F.expr(rule), F.lit(False)))
        parts = every.filter("every OR bits IS NOT NULL").groupBy("of").agg(F.collect_list(F.struct("first", "pn", F.when(F.col("every"), F.lit(None)).otherwise(F.col("bits")).alias("bits"))).alias("parts"))
        whole = blocks.filter("first = 0 AND count > 1").select(F.struct("key", "seg", "least", "count", "n").alias("o"))
        both = parts.join(whole, F.col("of") == F.col("o"), "full").select(F.coalesce("of", "o").alias("of"), F.coalesce("parts", F.expr("CAST(array() AS array<struct<first: bigint, pn: bigint, bits: binary>>)")).alias("parts"))
        flags = flags.unionByName(both.select("of.*", "parts").select("key", "seg", "least", "count", "n", "parts").mapInArrow(lean(_joined), "key long, seg binary, least long, count long, bits binary"))
    return flags


def _kernel(run: Callable):
    """Feeds the segments of each shard to ``run(keys, least, counts, ns, contents)``, which returns a bit array for each; they come by key."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        keys, count = rows.column(1).to_numpy(), rows.column(4).to_numpy()
        # A key with one segment left has nothing to compare it with: its windows repeat only as the whole segment does.
        alone = np.ones(len(keys) + 1, bool)
        alone[1:-1] = keys[1:] != keys[:-1]
        several = np.flatnonzero(~(alone[:-1] & alone[1:]))
        # No bits stand for none that is set.
        bits = [b""] * len(keys)
        if len(several):
            some = rows.take(pa.array(several))
            for k, got in zip(several.tolist(), run(*(some.column(c).to_pylist() for c in (1, 3, 4, 5, 6))), strict=True):
                if got.any():
                    bits[k] = np.packbits(got, bitorder="little").tobytes()
        keep = np.flatnonzero((count > 1) | np.array([len(b) > 0 for b in bits]))
        out = rows.select([1, 2, 3, 4]).take(pa.array(keep))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array([bits[k] for k in keep.tolist()], pa.binary())], ["key", "seg", "least", "count", "bits"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in pairwise(edges):
                if a == b:
                    continue
                if of[a] != shard and held:
                    yield close(held)
                    held = []
                shard = of[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close(held)

    return flag


def release(spark) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated(docs: DataFrame, spec: Windows, run: Callable, rule: str) -> DataFrame:
    """(id, least, copies, spans, text) of all documents; texts are never null, a null id is -2**63.

    ``least`` is the least id with this very text and ``copies`` the rows that have it; ``spans`` lists
    the flagged windows of the first of these as (start, n, bits), bits null for all n; null for none.

    ``rule``: an SQL condition on (id, least, count); where it holds all windows of a segment count as flagged.
    """
    spark = docs.sparkSession
    tune(spark)
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    rows = staged(base.groupBy("id", "tid").agg(F.count("*").alias("n")), "rows")
    classes = staged(rows.groupBy("tid").agg(F.min("id").alias("least"), F.sum("n").alias("copies")), "classes")
    pairs = staged(base.select("id", "tid", "text").mapInArrow(lean(_pairs(spec)), "anchor long, id long, tid binary, n int"), "pairs")
    of = F.xxhash64("tid")
    counted = pairs.groupBy("anchor").agg(F.min(of).alias("low"), F.max(of).alias("high"), F.sum("n").alias("n"), F.max("n").alias("most"))
    anchors = staged(counted.filter("low <> high" + (" OR most > 1" if spec.within else "")).select(F.col("anchor").alias("a"), (F.col("n") > HOT).alias("hot")), "anchors")
    release(spark)
    found_in = pairs.join(anchors, F.col("anchor") == F.col("a"))
    wanted = found_in.groupBy(F.col("id").alias("i"), F.col("tid").alias("t")).agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    first = classes.select(F.col("least").alias("l"), F.col("tid").alias("c"))
    wanted = staged(wanted.join(first, (F.col("i") == F.col("l")) & (F.col("t") == F.col("c")), "left_semi"), "wanted")
    release(spark)
    discard(pairs)
    fetched = base.join(wanted, (F.col("id") == F.col("i")) & (F.col("tid") == F.col("t"))).select("id", "tid", "anchors", "hot", "text")
    found = staged(fetched.mapInArrow(lean(_contents(spec)), "key long, seg binary, id long, tid binary, start long, n int, content binary"), "segments")
    release(spark)
    merged = staged(found.groupBy("key", "seg", "content").agg(F.min("id").alias("least"), F.count("*").alias("count"), F.max("n").alias("n")).select("key", "seg", "least", "count", "n", "content"), "merged")
    release(spark)
    whole = merged
    merged, levels = divide(merged, spec)
    total = merged.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(1, -(-total // spec.shard_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // TASK_BYTES), 20_000))
    dealt = merged.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "seg", "least", "count", "n", "content").repartition(parts, "shard").sortWithinPartitions("shard", "key", "least", "seg")
    flags = staged(dealt.mapInArrow(lean(_kernel(run)), "key long, seg binary, least long, count long, bits binary"), "flags")
    if levels:
        flags = staged(gathered(flags, levels, rule), "gathered")
    release(spark)
    discard(anchors, wanted, whole)
    hits = found.select("key", "seg", "id", "tid", "start", "n").join(flags.select(F.col("key").alias("k"), F.col("seg").alias("s"), "least", "count", "bits"), (F.col("key") == F.col("k")) & (F.col("seg") == F.col("s")))
    hits = hits.withColumn("every", F.expr(rule)).filter("every OR length(bits) > 0")
    spans = hits.groupBy("id", "tid").agg(F.collect_set(F.struct("start", "n", F.when(F.col("every"), F.lit(None)).otherwise(F.col("bits")).alias("bits"))).alias("spans"))
    info = rows.select("id", "tid").join(classes.withColumnRenamed("tid", "c"), F.col("tid") == F.col("c")).select(F.col("id").alias("i"), F.col("tid").alias("t"), "least", "copies")
    spans = spans.select(F.col("id").alias("si"), F.col("tid").alias("st"), "spans")
    facts = staged(info.join(spans, (F.col("i") == F.col("si")) & (F.col("t") == F.col("st")), "left").select("i", "t", "least", "copies", "spans"), "facts")
    release(spark)
    discard(found, flags, rows, classes)
    return base.join(facts, (F.col("id") == F.col("i")) & (F.col("tid") == F.col("t"))).select("id", "least", "copies", "spans", "text")


def covered(n: int, spans: list, length: int) -> np.ndarray:
    """Which of the n units a flagged window covers; spans as repeated() lists them."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans:
        if s["bits"] is None:
            edge[s["start"]] += 1
            edge[min(n, s["start"] + s["n"] + length - 1)] -= 1
        else:
            at = s["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8), bitorder="little", count=s["n"]))
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def all_covered(off: np.ndarray, spans: pa.ListArray, length: int) -> np.ndarray:
    """covered() for texts one after another; ``off`` are their n + 1 offsets."""
    edge = np.zeros(off[-1] + 1, np.int32)
    row = row_of(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy()))))
    flat = spans.flatten()
    start, bits = flat.field("start").to_numpy() + off[row], flat.field("bits")
    every = bits.is_null().to_numpy(zero_copy_only=False)
    end = start + flat.field("n").to_numpy() + length - 1
    np.add.at(edge, start[every], 1)
    np.add.at(edge, np.minimum(end, off[row + 1])[every], -1)
    packed, at = text_buffers(bits)
    bit = np.flatnonzero(np.unpackbits(packed, bitorder="little"))
    span = row_of(at)[bit >> 3]
    first = start[span] + bit - 8 * at[span]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0
