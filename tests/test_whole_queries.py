"""Queries that leave no graph and no text out, against their SQL and counts of the tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strata.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = df.select(*order).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.select(*[f'"{c}"' for c in order]).fetchall(), key=repr)
    return got


def test_run_dice_of_every_graph(spark, con):
    got = against_sql(spark, con, "run_dice")
    graphs = {r[0] for r in con.sql("SELECT r_regionkey FROM region").fetchall()}
    assert len(graphs) == 5 and {r["graph_id"] for r in got} == graphs
    assert all(r["run_a"] // 10 == r["run_b"] // 10 == r["graph_id"] for r in got)
    mean = entry.queries()["run_mean_dice"](spark, SF).collect()
    want = {}
    for r in got:
        total = r["n_a"] + r["n_b"]
        want.setdefault((r["graph_id"], r["key"]), []).append(round(2 * r["both"] / total, 4) if total else 1.0)
    assert {(r["graph_id"], r["key"]) for r in mean} == set(want)
    assert all(abs(r["mean"] - sum(w) / len(w)) < 1e-4 for r in mean for w in [want[r["graph_id"], r["key"]]])


def test_slug_of_the_whole_text(spark, con):
    got = against_sql(spark, con, "text_slug")
    long = con.sql("SELECT count(*) FROM conversations WHERE length(text) > 200").fetchall()[0][0]
    assert long and sum(r["n"] > 60 for r in got) >= long / 2
