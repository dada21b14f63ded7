"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated ``max_epochs`` times at most. The word budget is
shared by weight; a source whose share exceeds its cap is clamped and the excess goes to the others
by weight, until none is above. With sources sorted by cap / weight the fixpoint is one running sum:
source k is clamped exactly when cap_k / weight_k * (weights from k on) + (caps before k) <= budget.

A source's target is taken as whole repetitions of all its documents plus a fraction: documents in
the order of a seeded hash until the fraction is filled, the last one in part. The running sums that
this needs are made in two levels (sums of 4,096 hash buckets of each source, then inside a bucket),
so a source with a third of all rows is spread over the cluster.

Nulls: a null text has size 0; a null source is a source of its own, ordered last; a null doc_id is
ordered by the hash of an empty string. Rows of one doc_id are separate documents, in the order of size
and then of a hash of their text; equal ones are interchangeable. Texts of any length are counted whole. An empty table gives
an empty result; sources without words get target 0. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: float, budget: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    dec = "decimal(38,6)"
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * F.lit(epochs)).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("n", F.row_number().over(order))
    every, before, after = Window.partitionBy(), Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("budget", F.sum("source_size").over(every) * F.lit(budget))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_after", F.sum("weight").over(after))
        .withColumn("full", F.col("cap").cast(dec) * F.col("weights_after") <= F.col("weight") * (F.col("budget").cast(dec) - F.col("caps_before").cast(dec)))
    )
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - taken) / rest * F.col("weight")).alias("target"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), epochs: float = 2.0, budget: float = 1.5, seed: int = 17, keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, and the columns of ``docs`` in ``keep`` as a struct ``kept``."""
    kept = [F.struct(*[docs[c] for c in keep]).alias("kept"), F.xxhash64(docs["text"]).alias("tie")] if keep else []
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), *kept)
    d = d.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))).withColumn("bucket", F.substring("key", 1, 3))
    # One key without nulls, so that the windows and the join share a shuffle.
    d = d.withColumn("of", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, epochs, budget)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).withColumn("part", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before_bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    plan = buckets.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(F.coalesce(F.concat(F.lit("s"), F.col("b.source").cast("string")), F.lit("n")).alias("s"), F.col("b.bucket").alias("k"), "before_bucket", "source_size", "target", "epochs", "part")
    inside = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size", *["tie"] * bool(keep)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(plan, (F.col("of") == F.col("s")) & (F.col("bucket") == F.col("k")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("before_bucket") - F.col("before")))
    return d.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *(["kept"] if keep else []))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':17')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
        CAST(source_size * 2.0 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS n FROM w),
f AS (SELECT *, cap * (sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        <= w * (budget - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0))
        / (sum(CASE WHEN NOT is_full THEN w END) OVER ()) * w END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) - before_)) AS BIGINT) AS taken FROM p
"""
