"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strata.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
CHECKED = ["nest_by_level", "outline_flatten", "ancestor_closure", "hierarchical_outline", "graph_envelope", "summary_overview", "eval_near_matches_first", "eval_page_micro", "run_mean_dice", "heading_extract_number", "toc_line_parse", "toc_noise", "title_profiles", "stable_ids", "outline_spans", "outline_paths", "end_page_by_level", "heading_hierarchy", "ancestor_exclusion", "row_grouping", "toc_page_topk", "page_blob", "graph_nodes", "graph_edge_order", "violations_detail", "eval_set_metrics", "run_stats"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(rows, columns):
    order = sorted(columns)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(value(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(rel.fetchall(), rel.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["graph_id", "type", "n"]
    assert len(df._jdf.queryExecution().toString()) < 100_000
    assert all(r["n"] > 0 for r in df.collect())
