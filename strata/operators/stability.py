"""Agreement of repeated runs on a graph (key: run_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T

# The four sets that are compared.
KEYS = ["titles", "title_kind", "contains", "sequence"]


def run_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, key, a, b): distinct titles, (title, kind) and edges by title."""
    n = nodes.withColumn("t", T.stability_normalize_title("title"))
    t = n.filter("t <> ''")
    titles = t.select("run_id", F.lit("titles").alias("key"), F.col("t").alias("a"), F.lit("").alias("b"))
    kinds = t.select("run_id", F.lit("title_kind").alias("key"), F.col("t").alias("a"), T.stability_normalize_title("kind").alias("b"))
    of = n.filter("id IS NOT NULL AND id <> ''").groupBy("run_id", "id").agg(F.max_by("t", "pos").alias("t"))
    end = lambda k: of.select(F.col("run_id").alias(f"r{k}"), F.col("id").alias(f"i{k}"), F.col("t").alias(k))
    e = edges.filter(F.col("type").isin("contains", "sequence")).join(end("a"), (F.col("run_id") == F.col("ra")) & (F.col("source") == F.col("ia"))).join(end("b"), (F.col("run_id") == F.col("rb")) & (F.col("target") == F.col("ib")))
    return titles.unionByName(kinds).unionByName(e.filter("a <> '' AND b <> ''").select("run_id", F.col("type").alias("key"), "a", "b")).distinct()


def pair_dice(sets: DataFrame, runs: DataFrame, within: str | None = None) -> DataFrame:
    """(run_a, run_b, key, both, n_a, n_b, dice) for every pair of runs and key.

    With ``within``, a column of ``runs`` that each run has one value of, only runs that share it are
    paired, and it comes first.

    Common elements come from a join on the element, so sets are never copied for each pair; pairs of
    runs (a control table) are enumerated.
    """
    spark = sets.sparkSession
    place = [within] if within else []
    r = runs.select("run_id", *place).distinct()
    if within:
        sets = sets.join(r, "run_id")
    sizes = sets.groupBy("run_id", "key").agg(F.count("*").alias("n"))
    s, o = sets.alias("s"), sets.alias("o")
    both = s.join(o, F.expr("s.key = o.key AND s.a = o.a AND s.b = o.b AND s.run_id < o.run_id" + (f" AND s.{within} = o.{within}" if within else ""))).groupBy(F.col("s.run_id").alias("run_a"), F.col("o.run_id").alias("run_b"), F.col("s.key").alias("key")).agg(F.count("*").alias("both"))
    a, b = (r.withColumnRenamed("run_id", x) for x in ("run_a", "run_b"))
    pairs = (a.join(b, within) if within else a.crossJoin(b)).filter(F.col("run_a") < F.col("run_b")).crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in KEYS], "key string")))
    size = lambda k: sizes.select(F.col("run_id").alias(f"run_{k}"), "key", F.col("n").alias(f"n_{k}"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = pairs.join(both, ["run_a", "run_b", "key"], "left").join(size("a"), ["run_a", "key"], "left").join(size("b"), ["run_b", "key"], "left")
    return out.select(*place, "run_a", "run_b", "key", z("both").alias("both"), z("n_a").alias("n_a"), z("n_b").alias("n_b"), T.dice(z("both"), z("n_a"), z("n_b")).alias("dice"))


def run_stats(runs: DataFrame) -> DataFrame:
    """(runs, validation_pass_rate, nodes_mean, nodes_std, edges_mean, edges_std) of (run_id, validation_ok, node_count, edge_count)."""
    (nm, ns), (em, es) = T.mean_std(F.col("node_count")), T.mean_std(F.col("edge_count"))
    return runs.agg(F.count("*").alias("runs"), F.try_divide(F.count_if("validation_ok").cast("double"), F.count("*").cast("double")).alias("validation_pass_rate"), nm.alias("nodes_mean"), ns.alias("nodes_std"), em.alias("edges_mean"), es.alias("edges_std"))


def mean_dice(pairs: DataFrame, within: str | None = None) -> DataFrame:
    """(key, mean): each pair's value is rounded to 4 digits before the mean, and the mean again; null below two runs."""
    keys = [within, "key"] if within else ["key"]
    rounded = pairs.select(*keys, F.round(T.py_round(F.col("dice"), F.lit(4)) * 10_000).cast("long").alias("d"))
    # whole ten-thousandths, so that the order of the sum doesn't matter
    mean = F.sum("d").cast("double") / (F.count("*") * 10_000).cast("double")
    return rounded.groupBy(*keys).agg(mean.alias("m")).select(*keys, T.py_round(F.col("m"), F.lit(4)).alias("mean"))
