"""Inputs of the registered queries, derived from the tables by integer arithmetic, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: A course for each region: nation, market segment, customer.
GEO = """
WITH nat AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS o1 FROM {nation}),
cus AS (SELECT t.doc_id, t.n_nationkey, t.o1, c_custkey, c_name, c_mktsegment,
  CAST(dense_rank() OVER (PARTITION BY t.n_nationkey ORDER BY c_mktsegment) AS INT) AS o2,
  CAST(row_number() OVER (PARTITION BY t.n_nationkey, c_mktsegment ORDER BY c_custkey) AS INT) AS o3
  FROM {customer} JOIN nat t ON c_nationkey = t.n_nationkey)
SELECT CAST(doc_id AS INT) AS doc_id, o1, 0 AS o2, 0 AS o3, n_name AS title, CAST(o1 AS STRING) AS number,
  CASE WHEN n_nationkey % 2 = 0 THEN 50 END AS start_page, CASE WHEN n_nationkey % 3 = 0 THEN 10 END AS end_page, -1 AS src_key FROM nat
UNION ALL
SELECT DISTINCT CAST(doc_id AS INT), o1, o2, 0, c_mktsegment, concat(CAST(o1 AS STRING),'.',CAST(o2 AS STRING)), CAST(NULL AS INT), CAST(NULL AS INT), -1 FROM cus
UNION ALL
SELECT CAST(doc_id AS INT), o1, o2, o3, c_name, concat(CAST(o1 AS STRING),'.',CAST(o2 AS STRING),'.',CAST(o3 AS STRING)),
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1 + c_custkey % 97 AS INT) END,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1 + (c_custkey * 3) % 97 AS INT) END, CAST(c_custkey AS INT) FROM cus
"""

#: As GEO, with customers gone and renamed.
GEO2 = """
SELECT doc_id, o1, o2, o3, CASE WHEN src_key > 0 AND src_key % 13 = 0 THEN concat(title, ' x') ELSE title END AS title, number, start_page, end_page, src_key
FROM ({geo}) g WHERE src_key < 0 OR src_key % 11 <> 0
"""

#: As GEO, with upper-case copies of customers behind the others.
DUP = """
SELECT * FROM ({geo}) g UNION ALL
SELECT doc_id, o1, o2, o3 + 100000, upper(title), number, start_page, end_page, src_key FROM ({geo}) h WHERE src_key > 0 AND src_key % 23 = 0
"""

#: Flat lists with levels, one for each order.
FLAT = """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS i,
  CAST(1 + l_partkey % 3 AS INT) AS level, CAST(l_linenumber * 2 + l_suppkey % 2 AS INT) AS start_page, 40 AS total_pages,
  CAST(l_partkey AS INT) AS part, CAST(l_suppkey AS INT) AS supp FROM {lineitem}
"""

#: Heading lines of all kinds, one list for each order.
HEAD = """
SELECT doc_id, i, level, start_page, total_pages, CASE part % 6
  WHEN 0 THEN concat(CAST(1 + i % 3 AS STRING), '. Part ', CAST(part AS STRING))
  WHEN 1 THEN concat(CAST(1 + i % 3 AS STRING), '.', CAST(1 + supp % 3 AS STRING), ' Part ', CAST(part AS STRING))
  WHEN 2 THEN concat(CASE i % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END, ' - Part ', CAST(part AS STRING))
  WHEN 3 THEN concat('- Part ', CAST(part AS STRING))
  WHEN 4 THEN concat('Part ', CAST(part AS STRING))
  ELSE concat('Part ', CAST(part AS STRING), ' ..... ', CAST(1 + part % 60 AS STRING)) END AS text
FROM ({flat}) f
"""

#: Layout items of twenty documents, with their ancestors.
ITEMS = """
SELECT CAST(p_partkey % 20 AS INT) AS doc_id, 'texts' AS collection, CAST(p_partkey AS BIGINT) AS idx, concat('#/texts/', CAST(p_partkey AS STRING)) AS self_ref,
  CASE p_size % 6 WHEN 0 THEN concat('#/tables/', CAST(p_partkey % 7 AS STRING)) WHEN 1 THEN concat('#/pictures/', CAST(p_partkey % 5 AS STRING))
    WHEN 2 THEN '#/groups/1' WHEN 3 THEN '#/groups/2' ELSE '#/body' END AS parent_ref,
  CASE WHEN p_partkey % 29 = 0 THEN concat('PAGE ', CAST(1 + p_partkey % 11 AS STRING)) ELSE p_name END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'section_header' ELSE 'text' END AS label, CAST(NULL AS INT) AS level, CAST(NULL AS STRING) AS name, 'body' AS content_layer,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(100 + p_partkey % 9 AS INT) END AS page_no FROM {part}
UNION ALL SELECT DISTINCT CAST(p_partkey % 20 AS INT), 'groups', CAST(1 AS BIGINT), '#/groups/1', '#/groups/3', CAST(NULL AS STRING), 'form_area', CAST(NULL AS INT), CAST(NULL AS STRING), 'body', CAST(NULL AS INT) FROM {part}
UNION ALL SELECT DISTINCT CAST(p_partkey % 20 AS INT), 'groups', CAST(2 AS BIGINT), '#/groups/2', '#/body', CAST(NULL AS STRING), 'list', CAST(NULL AS INT), 'rich_cell_group_1', 'body', CAST(NULL AS INT) FROM {part}
UNION ALL SELECT DISTINCT CAST(p_partkey % 20 AS INT), 'groups', CAST(3 AS BIGINT), '#/groups/3', '#/groups/1', CAST(NULL AS STRING), 'list', CAST(NULL AS INT), CAST(NULL AS STRING), 'body', CAST(NULL AS INT) FROM {part}
"""

#: Text fragments with places.
FRAG = """
SELECT CAST(l_orderkey % 50 AS INT) AS doc_id, CAST(1 + l_linenumber % 3 AS INT) AS page,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 50, 1 + l_linenumber % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS pos,
  concat('Part ', CAST(l_partkey AS STRING)) AS text, CAST(72 + 18 * (l_suppkey % 4) AS DOUBLE) AS x0, CAST((l_partkey * 7) % 500 AS DOUBLE) AS y0,
  CAST(72 + 18 * (l_suppkey % 4) + 40 AS DOUBLE) AS x1, CAST((l_partkey * 7) % 500 + 10 AS DOUBLE) AS y1 FROM {lineitem}
"""

#: Conversations as recognised pages.
OCR = "SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS pos, CAST(turn AS INT) AS \"index\", text AS markdown FROM {conversations}"


def sql(name: str) -> str:
    """The fixture as SQL over the plain table names."""
    made = {t: t for t in TABLES}
    made["geo"] = GEO.format(**made)
    made["flat"] = FLAT.format(**made)
    return {"geo": GEO, "geo2": GEO2, "dup": DUP, "flat": FLAT, "head": HEAD, "items": ITEMS, "frag": FRAG, "ocr": OCR}[name].format(**made)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame; only the tables that it names are read."""
    text = sql(name).replace('"', "`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "lineitem", "part", "conversations") if f" {t}" in text}
    for t in used:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text, **used)


def outline(spark: SparkSession, sf_dir: str, name: str = "geo", root: bool = False) -> DataFrame:
    """A fixture with levels o1 to o3 as outline rows; ``root`` adds the region as the course."""
    g = frame(spark, sf_dir, name)
    o = g.select("doc_id", F.filter(F.array("o1", "o2", "o3"), lambda x: x > 0).alias("ord"), "title", "number", F.lit(None).cast("string").alias("role"), "start_page", "end_page", "src_key")
    if root:
        none = F.lit(None).cast("int")
        r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("doc_id"), F.array().cast("array<int>").alias("ord"), F.col("r_name").alias("title"), none.cast("string").alias("number"), none.cast("string").alias("role"), none.alias("start_page"), none.alias("end_page"), F.lit(-1).alias("src_key"))
        o = o.unionByName(r)
    return o
