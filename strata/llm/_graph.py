"""Connected components by contraction, with every round's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._shared import discard, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, label): the least vertex that each vertex of (a, b) reaches; vertices without another one may be missing.

    Each round every vertex hooks once, to the first of itself and its neighbours in some order; edges are
    renamed to what their ends hook to, those inside a component go, and equal ones merge. The order is that
    of the ids in every second round, which folds stars about their least vertex at once, and a new random one
    in the others, which leaves three quarters of the vertices at most in the mean (randomised contraction),
    whatever the graph; so rounds are logarithmic and no round has more edges than the one before. A vertex
    with very many edges is a skewed join key, which Spark splits, and minima are pre-aggregated.
    """
    e = staged(_tidy(edges.select("a", "b")), f"{name}-edges")
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        k = len(hooks)
        first = (lambda v: v) if k % 2 == 0 else (lambda v, k=k: F.xxhash64(F.lit(k), v))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("v")).agg(F.min_by("b", first(F.col("b"))).alias("u"), F.min(first(F.col("b"))).alias("place"))
        hooks.append(staged(best.select("v", F.when(first(F.col("v")) <= F.col("place"), F.col("v")).otherwise(F.col("u")).alias("to")), f"{name}-{k}"))
        end = lambda x: hooks[-1].select(F.col("v").alias(f"v{x}"), F.col("to").alias(f"to{x}"))
        renamed = e.join(end("a"), F.col("a") == F.col("va")).join(end("b"), F.col("b") == F.col("vb"))
        before, e = e, staged(_tidy(renamed.select(F.col("toa").alias("a"), F.col("tob").alias("b"))), f"{name}-{k}-edges")
        discard(before)
    if not hooks:
        return e.select(F.col("a").alias("v"), F.col("b").alias("label"))
    discard(e)
    root = hooks[-1]
    for k in reversed(range(len(hooks) - 1)):
        after = root.select(F.col("v").alias("u"), F.col("to").alias("above"))
        below, root = root, staged(hooks[k].join(after, F.col("to") == F.col("u"), "left").select("v", F.coalesce("above", "to").alias("to")), f"{name}-{k}-roots")
        discard(below)
    least = root.groupBy(F.col("to").alias("root")).agg(F.min("v").alias("label"))
    labels = staged(root.join(least, F.col("to") == F.col("root")).select("v", F.least("label", "to").alias("label")), f"{name}-labels")
    discard(root, *hooks[:-1])
    return labels


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
