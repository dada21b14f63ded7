"""Document fingerprints by I-Match with randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms (lower-case runs without ASCII space and punctuation) whose document
frequency lies in a band: at least ``rarest`` of all documents (and three), at most ``commonest``. As
frequencies of a text add up to its distinct terms, the lexicon has at most (mean distinct terms /
rarest) entries at every size of corpus; it is broadcast if it has at most ``max_broadcast`` rows and
else joined by shuffle.

A hash deals each term of the lexicon to one of LEVELS x SUBSETS subsets; those of level k get a
quarter of the terms of level k - 1, so texts of any length meet some subsets of which they have few
terms. A text's signature for a subset is a hash of its sorted distinct terms there. The fingerprint
lists subset and signature of the subsets that are not empty; the likeness of two fingerprints is the
share of equal signatures among the subsets that either has. A subset keeps its signature as long as
no term of it comes or goes, so likeness falls gently as a text is edited.

The terms above the band are dealt to subsets of their own, and no frequency cuts them. They count
only where a text is thin, that is, has fewer than one term in the band for THIN above it, as all near
copies are that come in a group of more than ``commonest`` of the rows: the fingerprint then lists
these subsets too, and a likeness is taken over both kinds if either text is thin.

The edited text of a document takes the start of the next one by doc_id. Documents are cut into
ranges of doc_id (quantiles), each range is one window partition, and only the first document of each
range crosses to the one before. A doc_id that is several quantiles at once, and the rows without one,
are ranges of their own, cut further by the digest of the text; only rows that are equal in both stay
together.

Nulls: a null text is empty; null doc_ids come first. Repeated rows follow each other in any order. A
text without terms of three documents has an empty fingerprint; empty fingerprints are alike (1.0) only if the
texts are equal. A single document is its own next one. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm._shared import staged

LEVELS, SUBSETS = 6, 16
THIN = 8
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return F.array_distinct(F.split(F.lower(text), BREAK))


def lexicon(docs: DataFrame, rarest: float, commonest: float) -> DataFrame:
    """(term, high): hashes of the terms in the band and above it."""
    frequency = docs.select(F.explode(terms(F.col("text"))).alias("w")).filter("w <> ''").select(F.xxhash64("w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    return frequency.filter("df >= 3").crossJoin(F.broadcast(total)).filter(F.col("df") >= F.col("total") * rarest).select("term", ((F.col("df") > F.col("total") * commonest) & (F.col("df") > 3)).alias("high"))


def _subset(term):
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(term.bitwiseAND(F.lit((4 ** (k + 1) - 1))) != 0, k).otherwise(level)
    return (level * SUBSETS + F.shiftrightunsigned(term, 40) % SUBSETS).cast("int")


def _signature(terms_):
    return F.xxhash64(F.array_sort(terms_)).bitwiseAND(F.lit(0xFFFFFFFF))


def _ranges(docs: DataFrame, n: int) -> list[tuple[int | None, int]]:
    """Ranges of like size in order, as (least doc_id, parts): first that of null, then that below all bounds.

    A doc_id that is k quantiles has about k / n of the rows; for k > 1 it is a range of its own, in k + 1 parts.
    """
    q = F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), 10 * n) if n > 1 else F.lit(None).cast("array<long>")
    got = docs.agg(q.alias("q"), F.count("*").alias("total"), F.count("doc_id").alias("known")).first()
    times = Counter(got["q"] or [])
    parts = {bound: k + 1 if k > 1 else 1 for bound, k in times.items()}
    for bound, k in times.items():
        if k > 1 and bound < 2**63 - 1:
            parts.setdefault(bound + 1, 1)
    nulls = got["total"] - got["known"]
    return [(None, 1 + nulls * n // max(1, got["total"])), (None, 1), *sorted(parts.items())]


def _longs(values: list[int]):
    """One array literal, however many values there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(doc_id, md5, ranges: list[tuple[int | None, int]]):
    """The number of a row's part of its range, in the order of doc_id and md5."""
    bounds = [low for low, _ in ranges[2:]]
    at = F.lit(1)
    if bounds:
        # How many bounds are at most doc_id, by two steps of about the root of their number.
        step = max(1, round(len(bounds) ** 0.5))
        c = F.size(F.filter(_longs(bounds[::step]), lambda b: b <= doc_id))
        fine = F.size(F.filter(F.slice(_longs(bounds), F.greatest((c - 1) * step + 1, F.lit(1)), F.lit(step)), lambda b: b <= doc_id))
        at = F.when(c == 0, 1).otherwise((c - 1) * step + fine + 1)
    place = (F.when(doc_id.isNull(), 0).otherwise(at) + 1).cast("int")
    first = [0, *accumulate(k for _, k in ranges)][:-1]
    start = F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")
    return (F.element_at(_longs(first), place) + F.shiftright(start * F.element_at(_longs([k for _, k in ranges]), place), 32)).cast("int")


def _follow(firsts: DataFrame, value: str) -> DataFrame:
    """(bucket, value of the next bucket's first row; after the last bucket the first one's)."""
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return firsts.select(F.col("bucket").alias("b"), F.coalesce(F.lead(value).over(order), F.first(value).over(whole)).alias("following"))


def _alike(a, b, equal):
    """Share of equal signatures among the subsets of either."""
    place = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(place(a), place(b)))
    return F.when(either == 0, equal.cast("double")).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprints(docs: DataFrame, rarest: float = 2e-5, commonest: float = 0.01, max_broadcast: int = 2_000_000, ranges: int | None = None) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    words = staged(lexicon(base, rarest, commonest), "lexicon")
    if words.count() <= max_broadcast:
        words = F.broadcast(words)
    cut = _ranges(base, ranges or min(20_000, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = base.withColumn("md5", F.md5("text")).withColumn("bucket", _bucket(F.col("doc_id"), F.col("md5"), cut))
    # The first document of each range, for the last one of the range before.
    firsts = ranged.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "md5")).alias("first"))
    following = _follow(firsts, "first").select("b", "following.doc_id", "following.md5")
    # At most one row for each part of a range, so at most three times 20,000.
    first_text = base.alias("d").join(F.broadcast(following).alias("f"), F.expr("d.doc_id <=> f.doc_id AND md5(d.text) = f.md5")).groupBy("b").agg(F.any_value("d.text").alias("first_text"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.col("md5"))
    rows = ranged.select("bucket", "doc_id", "md5", "text", F.row_number().over(order).alias("n"), F.lead("text").over(order).alias("next"))
    rows = rows.join(first_text, (F.col("bucket") == F.col("b")) & F.col("next").isNull(), "left")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.coalesce("next", "first_text"), F.lit(1), half))
    rows = rows.select("bucket", "n", "doc_id", "md5", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    facts = F.to_json(F.struct("doc_id", "n_chars", "md5", F.sha2("edited", 256).alias("sha"), (F.col("text") == F.col("edited")).alias("same")))
    parts = rows.select("bucket", "n", F.explode(F.array(F.struct(F.lit(0).alias("which"), terms(F.col("text")).alias("w")), F.struct(F.lit(1).alias("which"), terms(F.col("edited")).alias("w")), F.struct(F.lit(2).alias("which"), F.array(facts).alias("w")))).alias("x"))
    each = parts.select("bucket", "n", F.col("x.which").alias("which"), F.explode("x.w").alias("w")).withColumn("t", F.xxhash64("w"))
    kept = each.join(words, F.col("t") == F.col("term"), "left").filter("which = 2 OR term IS NOT NULL AND w <> ''")
    of = lambda k, high: F.when((F.col("which") == k) & (F.col("high") == high), F.col("t"))
    kept = kept.select("bucket", "n", F.when(F.col("which") == 2, -1).otherwise(_subset(F.col("t"))).alias("subset"), of(0, False).alias("a"), of(1, False).alias("b"), of(0, True).alias("ha"), of(1, True).alias("hb"), F.when(F.col("which") == 2, F.col("w")).alias("facts"))
    # Terms above the band are many: their signatures are exclusive ors, so that they leave a task as one number each.
    subsets = kept.groupBy("bucket", "n", "subset").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), *[F.bit_xor(F.when(F.col(x).isNotNull(), F.xxhash64(x))).alias(f"{x}_x") for x in ("ha", "hb")], *[F.count(x).alias(f"{x}_n") for x in ("ha", "hb")], F.max("facts").alias("facts"))
    place = lambda more: F.shiftleft((F.col("subset") + more).cast("long"), 32)
    code = lambda x: F.when(F.size(x) > 0, place(0).bitwiseOR(_signature(F.col(x)))).alias(x)
    high = lambda x: F.when(F.col(f"{x}_n") > 0, place(LEVELS * SUBSETS).bitwiseOR(F.xxhash64(f"{x}_x").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(x)
    coded = subsets.select("bucket", "n", "facts", code("a"), code("b"), high("ha"), high("hb"), *[(F.col(f"h{x}_n") - THIN * F.size(x)).alias(f"over_{x}") for x in "ab"])
    prints = coded.groupBy("bucket", "n").agg(F.max("facts").alias("facts"), *[F.array_sort(F.collect_list(x)).alias(x) for x in ("a", "b", "ha", "hb")], *[(F.sum(f"over_{x}") > 0).alias(f"thin_{x}") for x in "ab"])
    prints = staged(prints, "fingerprints")
    known = prints.withColumn("f", F.from_json("facts", "doc_id long, n_chars long, md5 string, sha string, same boolean")).withColumn("own", F.struct("a", F.col("ha").alias("high"), F.col("thin_a").alias("thin"), "f.md5"))
    along = Window.partitionBy("bucket").orderBy("n")
    after = _follow(known.filter("n = 1").select("bucket", "own"), "own")
    after = after.withColumnRenamed("b", "of")
    out = known.withColumn("next", F.lead("own").over(along)).join(after, (F.col("bucket") == F.col("of")) & F.col("next").isNull(), "left")
    nxt = F.coalesce("next", "following")
    whole = lambda a, high, thin: F.when(thin, F.concat(a, high)).otherwise(F.col(a) if isinstance(a, str) else a)
    either, beside = F.col("thin_a") | F.col("thin_b"), F.col("thin_a") | nxt["thin"]
    text = lambda x: F.array_join(F.transform(x, lambda v: F.lower(F.hex(v))), " ")
    return out.select(
        F.col("f.doc_id").alias("doc_id"),
        F.col("f.n_chars").alias("n_chars"),
        F.col("f.sha").alias("edited_sha256"),
        text(whole("a", "ha", F.col("thin_a"))).alias("fingerprint"),
        text(whole("b", "hb", F.col("thin_b"))).alias("edited_fingerprint"),
        _alike(whole("a", "ha", either), whole("b", "hb", either), F.col("f.same")).alias("near_edited"),
        _alike(whole("a", "ha", beside), whole(nxt["a"], nxt["high"], beside), F.col("f.md5") == nxt["md5"]).alias("near_next"),
    )
