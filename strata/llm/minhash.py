"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch (t coordinates): in round i every shingle of a set is thrown into one of t bins by a hash, and
a bin keeps the least value that it first got; rounds go on until every bin is filled, and rounds t
to 2t - 1 each fill one bin for certain. So every coordinate is filled, equal coordinates estimate
the Jaccard similarity with concentration as of t independent draws, and large sets need one round.

Documents with equal shingle sets are one class from the start, so exact copies cost one row each.
``bands`` bands of ``rows`` coordinates propose candidates: at the threshold s a pair is missed with
probability (1 - s**rows)**bands (2e-10 at 0.85, 5e-8 at 0.8 with 32 bands of 4). Documents that
share a bucket, directly or in a chain, form a cluster; no pair is written out for that.

Verification is exact, on full sets, and whole: every pair that shares a bucket and isn't yet known to be
connected is compared. A cluster of up to BLOCK sets is one task's step. In a larger one the member
that shares most buckets is a pivot, and all others are compared with it in one pass over blocks. If at
most BLOCK of them don't link with it, these are compared with all, again a block at a time. Else it is
done bucket by bucket: the unlinked of a bucket are compared with each other and with its linked ones, in
tiles of two blocks, each pair in the first bucket only that both are in. So work is quadratic in the
unlinked of one bucket at most, never in a cluster. A tile writes a spanning forest of its links, never
its pairs. Links then give connected components.

Sets: A-Z count as a-z; words are runs of non-space bytes; a text with fewer than ``n`` words is one
shingle of all its words. Words and shingles are compared by 64-bit hashes that aren't linear, sets by
two sums of such hashes. Nulls: a null or empty text has an empty set and links with nothing; rows
with a null doc_id link with nothing and get a null component_id, kept. Rows of one doc_id are one
document: their texts' classes are linked, and each row gets the document's component. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._bytes import U64, mix, row_of, signed, slices, text_buffers, word_hashes, words
from strata.llm._graph import components
from strata.llm._shared import discard, lean, staged, tune

#: Sets in a block of a large cluster, and the shingles after which a block counts as full.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, ascending in each text; index of each text's first, n + 1)."""
    starts, ends, first = words(buf, off)
    w = word_hashes(buf, starts, ends, lower=True)
    count = np.diff(first)
    doc = row_of(first)
    k = len(w) - n + 1
    parts, owner = [], []
    if k > 0:
        h = np.full(k, U64(n))
        for i in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + w[i : i + k])
        inside = doc[:k] == doc[n - 1 :]
        parts.append(h[inside])
        owner.append(doc[:k][inside])
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = np.full(1, U64(count[d]))
        for x in w[first[d] : first[d + 1]]:
            h = mix(h * U64(0x9E3779B97F4A7C15) + x)
        parts.append(h)
        owner.append(np.full(1, d))
    if not parts:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    h, d = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(off)))


def sketches(h: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The sketch of each set, one row of t values each; rows of empty sets are all ones."""
    n = len(first) - 1
    out = np.full(n * t, ~U64(0))
    size = np.diff(first)
    open_ = size > 0
    doc = row_of(first)
    for i in range(2 * t):
        if not open_.any():
            break
        if not open_.all():
            on = open_[doc]
            h, doc = h[on], doc[on]
        x = mix(h ^ U64((i + 1) * 0xD6E8FEB86659FD93 % 2**64))
        slot = (x >> U64(32)).astype(np.int64) * t >> 32 if i < t else np.full(len(x), i - t)
        np.minimum.at(out, doc * t + slot, (U64(i) << U64(56)) | (mix(x) >> U64(8)))
        open_ &= (out.reshape(n, t) == ~U64(0)).any(1)
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sketch), bands), U64)
    for b in range(bands):
        h = np.full(len(sketch), U64(b + 1))
        for r in range(rows):
            h = mix(h * U64(31) + sketch[:, b * rows + r])
        keys[:, b] = h
    return keys


def _profiles(n: int, bands: int, rows: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_buffers(part.column(1))
                h, first = shingle_sets(buf, off, n)
                keys = band_keys(sketches(h, first, bands * rows), bands, rows)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), *map(pa.array, _sums(h, first)), listed], ["doc_id", "n", "s1", "s2", "keys"])

    return profile


def _sums(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes that name each set."""
    out = []
    for salt in (0x51, 0x7F):
        c = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + U64(salt)), dtype=U64)))
        out.append(signed(c[first[1:]] - c[first[:-1]]))
    return out


def _sets(n: int):
    """Sets of the texts that have the sums asked for: a repeated doc_id may have other texts too, or the same text again."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = text_buffers(part.column(part.schema.get_field_index("text")))
                h, first = shingle_sets(buf, off, n)
                s1, s2 = _sums(h, first)
                same = (s1 == part.column(4).to_numpy()) & (s2 == part.column(5).to_numpy())
                keep = []
                for k, c in enumerate(part.column(3).to_pylist()):
                    if same[k] and c != last:
                        keep.append(k)
                        last = c
                sets = [h[first[k] : first[k + 1]].tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays([*(part.column(x).take(pa.array(keep, pa.int64())) for x in range(4)), pa.array(sets, pa.binary())], ["cluster", "blocks", "pivot", "c", "shingles"])

    return fetch


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _link(sets: list[np.ndarray], left: list[int], right: list[int], num: int, den: int, forest: _Forest, keys: np.ndarray | None = None, band: int = 0) -> list[tuple[int, int]]:
    """Links between the sets ``left`` and ``right`` (indices) that join two trees of the forest.

    With ``keys`` (a row of bucket keys for each set) only pairs whose first common bucket is that of ``band``.
    """
    every = np.concatenate(sets) if sets else np.zeros(0, U64)
    _, ids = np.unique(every, return_inverse=True)
    size = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int32)
    same = left is right
    r = np.array(right)
    pieces = ids if len(right) == len(sets) and right == list(range(len(sets))) else np.concatenate([ids[at[k] : at[k + 1]] for k in right])
    edge = np.concatenate(([0], np.cumsum(size[r])))
    found = []
    for p, i in enumerate(left):
        k = p + 1 if same else 0
        if k >= len(r):
            break
        if keys is None:
            new = True
        else:
            new = ~(keys[r[k:], :band] == keys[i, :band]).any(1)
            if not new.any():
                continue
        mark[ids[at[i] : at[i + 1]]] = 1
        inter = np.add.reduceat(mark[pieces[edge[k] :]], edge[k:-1] - edge[k])
        mark[ids[at[i] : at[i + 1]]] = 0
        ok = (den * inter >= num * (size[i] + size[r[k:]] - inter)) & new
        for j in r[k:][ok].tolist():
            if i != j and forest.join(i, j):
                found.append((i, j))
    return found


def _tiles(num: int, den: int):
    """Rows of (cluster, tile, side, c, shingles, key, keys), those of a tile together: links (a, b) that span the tile's components.

    side 0: compare with each other; 1: compare with side 2; 2: only compared with by sides 1 and 3. Side 3: the
    pivot. ``key`` is the bucket of a tile of one bucket, which is one of ``keys``; else both are null.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, docs, sides, sets, keys = None, [], [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(docs) < 2:
                return
            forest = _Forest(len(docs))
            by = {s: [k for k, x in enumerate(sides) if x == s] for s in range(4)}
            of, band = None, 0
            if tile[2] is not None:
                of = np.array(keys, np.int64)
                band = int(np.flatnonzero(of[0] == tile[2])[0])
            for a, b in ((0, 0), (1, 2), (3, 2)):
                if by[a] and by[b]:
                    out.extend((docs[x], docs[y]) for x, y in _link(sets, by[a], by[b], num, den, forest, of, band))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for cluster, name, side, c, shingles, key, own in zip(*columns, strict=True):
                if (cluster, name, key) != tile:
                    close()
                    tile, docs, sides, sets, keys = (cluster, name, key), [], [], [], []
                if docs and docs[-1] == c and sides[-1] == side:
                    continue
                docs.append(c)
                sides.append(side)
                sets.append(np.frombuffer(shingles, U64))
                keys.append(own)
            if out:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    return verify


def _verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    for column, kind in (("key", "long"), ("keys", "array<long>")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    together = rows.select("cluster", F.col("tile").cast("string").alias("tile"), "side", "c", "shingles", "key", "keys").repartition("cluster", "tile").sortWithinPartitions("cluster", "tile", "key", "side", "c")
    return together.mapInArrow(lean(_tiles(num, den)), "a long, b long")


def _crossed(open_: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """Tiles of the rows ``open_`` (c, block, blocks, ...) among each other, and with the blocks of ``known``, in each group ``by``."""
    rest = [c for c in open_.columns if c not in ("block", "blocks")]
    each = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    among = each.withColumn("tile", F.format_string("f%d-%d", F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2))
    seen = known.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col("block").alias("other")).distinct()
    left = open_.join(seen, [F.col(c) == F.col(f"k_{c}") for c in by]).withColumn("tile", F.format_string("u%d-%d", "block", "other")).withColumn("side", F.lit(1))
    have = open_.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col("block").alias("other")).distinct()
    right = known.join(have, [F.col(c) == F.col(f"k_{c}") for c in by]).withColumn("tile", F.format_string("u%d-%d", "other", "block")).withColumn("side", F.lit(2))
    return reduce(DataFrame.unionByName, [x.select(*rest, "tile", "side") for x in (among, left, right)])


def _blocked(rows: DataFrame, count) -> DataFrame:
    """``rows`` dealt by a hash of c to blocks of about BLOCK out of ``count``."""
    blocks = F.greatest(F.lit(1), F.ceil(count / BLOCK)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))


def _large_links(large: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) in clusters of several blocks: rows (cluster, blocks, pivot, c, shingles)."""
    dealt = large.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    pivots = dealt.filter("c = pivot").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(3))
    columns = ["cluster", "tile", "side", "c", "shingles"]
    first = staged(_verified(dealt.filter("c <> pivot").withColumn("tile", F.col("block")).withColumn("side", F.lit(2)).select(*columns).unionByName(pivots.select(*columns)), num, den), "pivot-links")
    linked = first.select(F.explode(F.array("a", "b")).alias("known")).distinct()
    small = large.select("cluster", "c", "shingles").join(linked, F.col("c") == F.col("known"), "left").withColumn("free", F.col("known").isNull()).drop("known")
    flagged = staged(small, "flagged")
    free = staged(flagged.filter("free").groupBy(F.col("cluster").alias("fc")).agg(F.count("*").alias("n_free")), "free")
    rows = flagged.join(free, F.col("cluster") == F.col("fc")).drop("fc")
    total = rows.filter("NOT free").groupBy(F.col("cluster").alias("kc")).agg(F.count("*").alias("n_known"))
    # Few unlinked sets: one block of them against every block of the linked ones.
    few = rows.filter(F.col("n_free") <= BLOCK)
    open_few = _blocked(few.filter("free"), F.col("n_free")).select("cluster", "c", "shingles", "block", "blocks")
    known_few = _blocked(few.filter("NOT free").join(total, F.col("cluster") == F.col("kc")), F.col("n_known")).select("cluster", "c", "shingles", "block", "blocks")
    links = first.unionByName(_verified(_crossed(open_few, known_few, ["cluster"]), num, den))
    # Many: bucket by bucket, where a bucket has an unlinked set.
    many = rows.filter(F.col("n_free") > BLOCK).select("c", "shingles", "free").join(classes.select(F.col("c").alias("cc"), "keys"), F.col("c") == F.col("cc")).drop("cc")
    member = many.select("c", "free", F.explode("keys").alias("key"))
    counts = staged(member.groupBy(F.col("key").alias("k")).agg(F.count_if("free").alias("n_free"), F.count_if(~F.col("free")).alias("n_known")).filter("n_free > 0 AND n_free + n_known > 1"), "open-buckets")
    if counts.isEmpty():
        return links
    inside = staged(many.withColumn("key", F.explode("keys")).join(counts, F.col("key") == F.col("k")).select(F.col("key").alias("cluster"), "key", "keys", "c", "shingles", "free", "n_free", "n_known"), "open-sets")
    columns = ["cluster", "key", "keys", "c", "shingles", "block", "blocks"]
    open_ = _blocked(inside.filter("free"), F.col("n_free")).select(*columns)
    known = _blocked(inside.filter("NOT free"), F.col("n_known")).select(*columns)
    return links.unionByName(_verified(_crossed(open_, known, ["cluster"]), num, den))


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Linked: den * intersection >= num * union."""
    tune(docs.sparkSession)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    profiles = staged(base.mapInArrow(lean(_profiles(n, bands, rows)), "doc_id long, n long, s1 long, s2 long, keys array<long>"), "profiles")
    # A class is all documents of one set. Its number c is given once, in the table that is written.
    classes = profiles.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc"), F.any_value("keys").alias("keys"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    # Buckets with several classes; the least member stands for the bucket.
    member = classes.select("c", F.col("n").alias("size"), F.explode("keys").alias("key"))
    buckets = staged(member.groupBy("key").agg(F.count("*").alias("members"), F.min("c").alias("least")).filter("members > 1").select(F.col("key").alias("k"), "members", "least"), "buckets")
    shared = staged(member.join(buckets, F.col("key") == F.col("k")).groupBy("c", "least").agg(F.sum("members").alias("shared"), F.max("size").alias("size")), "shared")
    cluster = components(shared.select(F.col("c").alias("a"), F.col("least").alias("b")), "clusters")
    scored = shared.groupBy("c").agg(F.sum("shared").alias("shared"), F.max("size").alias("size")).join(cluster, F.col("c") == F.col("v")).select("c", F.col("label").alias("cluster"), "shared", "size")
    sizes = scored.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"), F.max_by("c", F.struct("shared", -F.col("c"))).alias("pivot"))
    sizes = sizes.select(F.col("cluster").alias("of"), "pivot", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    named = classes.select(F.col("c").alias("cc"), "doc", "s1", "s2")
    wanted = scored.join(sizes, F.col("cluster") == F.col("of")).join(named, F.col("c") == F.col("cc")).select("doc", "c", "cluster", "pivot", "blocks", "s1", "s2")
    # One plan at every size: texts meet the wanted ids by a merge join.
    text = base.join(wanted.hint("merge"), F.col("doc_id") == F.col("doc")).select("cluster", "blocks", "pivot", "c", "s1", "s2", "text")
    sets = staged(text.mapInArrow(lean(_sets(n)), "cluster long, blocks int, pivot long, c long, shingles binary"), "sets")
    links = _verified(sets.filter("blocks = 1").withColumn("tile", F.lit("")).withColumn("side", F.lit(0)), num, den)
    large = sets.filter("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, classes, num, den))
    discard(buckets, shared)
    # Rows of one doc_id with different sets link their classes.
    ends = lambda x: [F.min(x).alias(f"{x}_low"), F.max(x).alias(f"{x}_high")]
    several = staged(profiles.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("r")).agg(*ends("s1"), *ends("s2")).filter("s1_low <> s1_high OR s2_low <> s2_high").select("r"), "several")
    of_several = staged(profiles.select("doc_id", "n", "s1", "s2").join(several, F.col("doc_id") == F.col("r"), "left_semi").distinct().join(classes.drop("keys"), ["s1", "s2", "n"]).select("doc_id", "c"), "of-several")
    one = of_several.groupBy(F.col("doc_id").alias("o")).agg(F.min("c").alias("b"))
    group = components(links.unionByName(of_several.join(one, F.col("doc_id") == F.col("o")).select(F.col("c").alias("a"), "b")), "links")
    # A component goes by its least doc_id.
    joined = group.join(classes.select("c", "doc"), F.col("v") == F.col("c")).select("v", "label", "doc")
    least = joined.groupBy(F.col("label").alias("l")).agg(F.min("doc").alias("component"))
    joined = joined.join(least, F.col("label") == F.col("l")).select("v", "component")
    of_class = staged(classes.select("s1", "s2", F.col("n").alias("size"), "c", "doc").join(joined, F.col("c") == F.col("v"), "left").select("s1", "s2", "size", "c", F.coalesce("component", "doc").alias("component")), "components")
    discard(sets, group, cluster)
    of_doc = of_several.join(of_class.select(F.col("c").alias("cc"), "component"), F.col("c") == F.col("cc")).groupBy(F.col("doc_id").alias("d")).agg(F.min("component").alias("together"))
    p = profiles.select("doc_id", "n", "s1", "s2").alias("p")
    out = p.join(of_class.drop("c").alias("c"), F.expr("p.s1 = c.s1 AND p.s2 = c.s2 AND p.n = c.size AND p.doc_id IS NOT NULL"), "left").select("doc_id", F.col("n").alias("n_shingles"), "component")
    out = out.join(of_doc, F.col("doc_id") == F.col("d"), "left").select("doc_id", "n_shingles", F.coalesce("together", "component", "doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
