"""Queries on graphs: construction, validation, summaries, scoring, error report, stability, sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import errors as R
from strata.operators import evaluate as E
from strata.operators import graph as G
from strata.operators import outline as O
from strata.operators import stability as Y
from strata.operators import summary as B
from strata.operators import validate as V
from strata.plans import fixtures as X
from strata.plans.structure_queries import SPANS, UNDER, read
from strata.sources import sinks as S
from strata.staging import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Graphs compiled from the course outlines ---------------------------------------------------------


def compiled(spark, d, name: str = "geo") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with pos, and src_key on the nodes."""
    o = O.recompute_spans(X.outline(spark, d, name, root=True))
    n = staged(G.positioned(G.nodes(o, keep=("src_key",)), "ord"), "nodes")
    return n, staged(G.positioned(G.edges(n), "at"), "edges")


def _ctes(name: str, p: str) -> str:
    """CTEs {p}n (nodes) and {p}e (edges) of the graph compiled from a course fixture."""
    spans = SPANS.format(f"{p}g").replace("s AS (", f"{p}s AS (", 1).replace("\ne AS (", f"\n{p}x AS (", 1).replace("\nm AS (", f"\n{p}m AS (", 1).replace("JOIN s USING", f"JOIN {p}s USING").replace("JOIN e d", f"JOIN {p}x d").replace(UNDER, UNDER.replace("a.o1 = d.o1", "(a.o1 = 0 OR a.o1 = d.o1)"))
    page = lambda c: f"CASE WHEN coalesce({c}, 0) = 0 THEN '' ELSE CAST({c} AS STRING) END"
    return f"""{p}g AS (SELECT * FROM ({X.sql(name)}) z UNION ALL SELECT CAST(r_regionkey AS INT), 0, 0, 0, r_name, NULL, NULL, NULL, -1 FROM region),
{spans},
{p}b AS (SELECT g.*, s.s AS page_start, m.e AS page_end, CASE WHEN o1 = 0 THEN 0 WHEN o2 = 0 THEN 1 WHEN o3 = 0 THEN 2 ELSE 3 END AS depth FROM {p}g g JOIN {p}s s USING (doc_id, o1, o2, o3) JOIN {p}m m USING (doc_id, o1, o2, o3)),
{p}k AS (SELECT b.*, CASE WHEN b.depth = 0 THEN 'COURSE' WHEN NOT EXISTS (SELECT 1 FROM {p}b c WHERE c.doc_id = b.doc_id AND c.depth = b.depth + 1 AND (b.depth = 0 OR c.o1 = b.o1) AND (b.depth < 2 OR c.o2 = b.o2)) THEN 'KC' WHEN b.depth = 1 THEN 'MODULE' ELSE 'UNIT' END AS kind,
  list_filter([r.title, CASE WHEN b.depth > 0 THEN a.title END, CASE WHEN b.depth > 1 THEN u.title END, CASE WHEN b.depth > 2 THEN b.title END], lambda x: x IS NOT NULL) AS path
  FROM {p}b b JOIN {p}b r ON r.doc_id = b.doc_id AND r.o1 = 0 LEFT JOIN {p}b a ON a.doc_id = b.doc_id AND a.o1 = b.o1 AND a.depth = 1 LEFT JOIN {p}b u ON u.doc_id = b.doc_id AND u.o1 = b.o1 AND u.o2 = b.o2 AND u.depth = 2),
{p}n AS (SELECT doc_id AS graph_id, o1, o2, o3, depth, kind, title, CASE WHEN depth > 0 THEN number END AS number, page_start, page_end, path, src_key,
  concat(kind, '_', substring(sha1(CASE WHEN depth = 0 THEN title ELSE concat(array_to_string(path, '||'), '||', number, '||', {page('page_start')}, '||', {page('page_end')}) END), 1, 12)) AS id,
  CASE WHEN page_start <= page_end THEN range(page_start, page_end + 1) WHEN page_start IS NOT NULL THEN [page_start] WHEN page_end IS NOT NULL THEN [page_end] ELSE [] END AS evidence,
  row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, o3) - 1 AS pos FROM {p}k),
{p}e AS (SELECT c.graph_id, a.id AS source, c.id AS target, 'contains' AS type, a.title AS st, a.number AS sn, a.kind AS sk, c.title AS tt, c.number AS tn, c.kind AS tk FROM {p}n c JOIN {p}n a ON a.graph_id = c.graph_id AND a.depth = c.depth - 1 AND (a.depth = 0 OR a.o1 = c.o1) AND (a.depth < 2 OR a.o2 = c.o2)
  UNION ALL SELECT graph_id, id, nid, 'sequence', title, number, kind, ntitle, nnumber, nkind FROM (SELECT *, lead(id) OVER w AS nid, lead(title) OVER w AS ntitle, lead(number) OVER w AS nnumber, lead(kind) OVER w AS nkind FROM {p}n
    WINDOW w AS (PARTITION BY graph_id, depth, CASE WHEN depth > 1 THEN o1 END, CASE WHEN depth > 2 THEN o2 END ORDER BY o1, o2, o3)) q WHERE nid IS NOT NULL AND depth > 0)"""


GEO = "WITH " + _ctes("geo", "g")


@query(GEO + " SELECT graph_id, pos, id, kind, title, number, page_start, page_end, array_to_string(evidence, ',') AS evidence, array_to_string(path, ' > ') AS path FROM gn")
def graph_nodes(spark, d):
    n, _ = compiled(spark, d)
    return n.select("graph_id", "pos", "id", "kind", "title", "number", "page_start", "page_end", F.array_join(F.col("evidence_pages").cast("array<string>"), ",").alias("evidence"), F.array_join("path", " > ").alias("path"))


@query(GEO + " SELECT graph_id, source, target FROM ge WHERE type = 'contains'")
def graph_contains(spark, d):
    n, _ = compiled(spark, d)
    return G.contains(n).select("graph_id", "source", "target")


@query(GEO + " SELECT graph_id, source, target FROM ge WHERE type = 'sequence'")
def graph_sequence(spark, d):
    n, _ = compiled(spark, d)
    return G.sequence(n).select("graph_id", "source", "target")


@query(
    GEO
    + """, c AS (SELECT graph_id, o1, o2, o3, id, depth FROM gn), k AS (
  SELECT graph_id, id AS target, 'contains' AS type, [o1, o2, o3] AS place FROM c WHERE depth > 0
  UNION ALL SELECT graph_id, nid, 'sequence', CASE depth WHEN 1 THEN [2147483647, o1, 0] WHEN 2 THEN [o1, 2147483647, o2] ELSE [o1, o2, 2147483647] END FROM (SELECT *, lead(id) OVER (PARTITION BY graph_id, depth, CASE WHEN depth > 1 THEN o1 END, CASE WHEN depth > 2 THEN o2 END ORDER BY o1, o2, o3) AS nid FROM c) q WHERE nid IS NOT NULL AND depth > 0)
  SELECT graph_id, type, sum(r * (r % 97)) AS check_sum FROM (SELECT graph_id, type, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY place, target) AS BIGINT) AS r FROM k) x GROUP BY ALL"""
)
def graph_edge_order(spark, d):
    """The place of every edge in its graph's list, summed up by type."""
    _, e = compiled(spark, d)
    r = F.col("pos") + 1
    return e.groupBy("graph_id", "type").agg(F.sum(r * (r % 97)).alias("check_sum"))


# Summaries --------------------------------------------------------------------------------------


@query(GEO + ", k AS (SELECT unnest(['COURSE', 'MODULE', 'UNIT', 'KC']) AS kind) SELECT g.graph_id, k.kind, count(n.id) AS n, CAST(coalesce(min(len(path)), 0) AS BIGINT) AS min_depth, CAST(coalesce(max(len(path)), 0) AS BIGINT) AS max_depth, CAST(coalesce(sum(len(path)), 0) AS BIGINT) AS depth_sum, CASE WHEN count(n.id) = 0 THEN 0.0 ELSE CAST(sum(len(path)) AS DOUBLE) / CAST(count(n.id) AS DOUBLE) END AS depth_avg FROM (SELECT DISTINCT graph_id FROM gn) g CROSS JOIN k LEFT JOIN gn n ON n.graph_id = g.graph_id AND n.kind = k.kind GROUP BY ALL")
def summary_by_kind(spark, d):
    return B.by_kind(compiled(spark, d)[0])


@query(GEO + " SELECT graph_id, type, count(*) AS n FROM ge GROUP BY ALL")
def summary_by_edge_type(spark, d):
    return B.by_edge_type(compiled(spark, d)[1])


@query(GEO + " SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE CAST(grounded AS DOUBLE) / CAST(total AS DOUBLE) * 100 END AS percent FROM (SELECT graph_id, count(*) FILTER (kind = 'KC' AND (page_start IS NOT NULL OR page_end IS NOT NULL)) AS grounded, count(*) FILTER (kind = 'KC') AS total, max(len(path)) AS max_path_length FROM gn GROUP BY graph_id) x")
def kc_grounding(spark, d):
    n, _ = compiled(spark, d)
    return B.kc_grounding(n).join(B.max_path_length(n), "graph_id").select("graph_id", "grounded", "total", "max_path_length", "percent")


# Violations ---------------------------------------------------------------------------------------

#: Graphs with faults: a course for each nation, a module for each segment, a KC for each customer; keys decide what is wrong.
BAD_NODES = """
SELECT n_nationkey AS graph_id, CAST(0 AS BIGINT) AS pos, 'c' AS id, CASE WHEN n_nationkey % 7 = 3 THEN 'UNIT' ELSE 'COURSE' END AS kind, n_name AS title, 1 AS page_start, 60 AS page_end, 1 AS n_pages, n_name AS p1, CAST(NULL AS STRING) AS p2, CAST(NULL AS STRING) AS p3 FROM {nation}
UNION ALL SELECT DISTINCT c_nationkey, CAST(1 + length(c_mktsegment) AS BIGINT), c_mktsegment, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'MODULE' ELSE 'UNIT' END, c_mktsegment, 2, CASE WHEN c_nationkey % 5 = 1 THEN 20 ELSE 50 END, 0, n_name, c_mktsegment, CAST(NULL AS STRING) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT c_nationkey, 100 + c_custkey, CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 61 = 0 THEN 'twin' ELSE CAST(c_custkey AS STRING) END,
  CASE WHEN c_custkey % 43 = 0 THEN 'ODD' WHEN c_custkey % 71 = 0 THEN 'UNIT' WHEN c_custkey % 73 = 0 THEN 'MODULE' WHEN c_custkey % 97 = 0 THEN 'COURSE' ELSE 'KC' END,
  CASE WHEN c_custkey % 47 = 0 THEN ' ' WHEN c_custkey % 5 = 0 THEN 'Same' ELSE c_name END,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1 + c_custkey % 30 AS INT) END, CASE WHEN c_custkey % 9 IN (0, 4) THEN NULL ELSE CAST(10 + c_custkey % 45 AS INT) END, CAST(c_custkey % 2 AS INT),
  CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN 'Other' ELSE n_name END, CASE WHEN c_custkey % 59 = 0 THEN NULL ELSE c_mktsegment END,
  CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 67 = 0 THEN 'Else' WHEN c_custkey % 47 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'Same' ELSE c_name END FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
BAD_EDGES = """
SELECT DISTINCT c_nationkey AS graph_id, CAST(length(c_mktsegment) AS BIGINT) AS pos, 'c' AS source, c_mktsegment AS target, 'contains' AS type FROM {customer}
UNION ALL SELECT c_nationkey, 100 + c_custkey, c_mktsegment, CASE WHEN c_custkey % 79 = 0 THEN 'nowhere' ELSE CAST(c_custkey AS STRING) END, CASE WHEN c_custkey % 83 = 0 THEN 'odd' WHEN c_custkey % 89 = 0 THEN NULL ELSE 'contains' END FROM {customer}
UNION ALL SELECT c_nationkey, 100000 + c_custkey, 'c', CAST(c_custkey AS STRING), 'contains' FROM {customer} WHERE c_custkey % 29 = 0
UNION ALL SELECT c_nationkey, 150000 + c_custkey, CAST(c_custkey AS STRING), c_mktsegment, 'contains' FROM {customer} WHERE c_custkey % 101 = 0
UNION ALL SELECT graph_id, 200000 + k, CASE WHEN k % 37 = 0 THEN CAST(nxt AS STRING) ELSE CAST(k AS STRING) END, CASE WHEN k % 37 = 0 THEN CAST(k AS STRING) WHEN k % 31 = 0 THEN CAST(k AS STRING) WHEN k % 23 = 0 THEN CAST(nxt2 AS STRING) ELSE CAST(nxt AS STRING) END, 'sequence'
  FROM (SELECT c_nationkey AS graph_id, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nxt, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nxt2 FROM {customer}) x WHERE nxt IS NOT NULL AND nxt2 IS NOT NULL
UNION ALL SELECT c_nationkey, 300000 + c_custkey, CAST(c_custkey AS STRING), CAST(c_custkey + 1 AS STRING), 'sequence' FROM {customer} WHERE c_custkey % 13 = 0
UNION ALL SELECT c_nationkey, 400000 + c_custkey, CAST(c_custkey AS STRING), CAST(c_custkey + 1 AS STRING), 'sequence' FROM {customer} WHERE c_custkey % 26 = 0
UNION ALL SELECT graph_id, 500000 + k, CAST(nxt AS STRING), CAST(k AS STRING), 'sequence' FROM (SELECT c_nationkey AS graph_id, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS nxt FROM {customer}) y WHERE nxt IS NOT NULL AND k % 19 = 0
"""


def bad(spark, d) -> tuple[DataFrame, DataFrame]:
    tables = {t: read(spark, d, t) for t in ("nation", "customer")}
    n = spark.sql(BAD_NODES, **tables)
    path = F.filter(F.array("p1", "p2", "p3"), lambda x: x.isNotNull())
    n = n.select("graph_id", "pos", "id", "kind", "title", "page_start", "page_end", F.when(F.col("n_pages") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("evidence_pages"), path.alias("path"))
    return staged(n, "bad-nodes"), staged(spark.sql(BAD_EDGES, customer=tables["customer"]), "bad-edges")


VIOLATIONS = f"""WITH nn AS ({BAD_NODES.format(nation="nation", customer="customer")}), ee AS ({BAD_EDGES.format(customer="customer")}),
r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY pos) AS k FROM nn WHERE id IS NOT NULL), n1 AS (SELECT * FROM r WHERE k = 1),
c AS (SELECT e.graph_id, e.pos, e.source, e.target, s.kind AS sk, t.kind AS tk, s.page_start AS ss, s.page_end AS se, t.page_start AS ts, t.page_end AS te, s.title AS st, t.title AS tt, s.p1 AS s1, s.p2 AS s2, s.p3 AS s3, t.p1 AS t1, t.p2 AS t2, t.p3 AS t3
  FROM ee e JOIN n1 s ON s.graph_id = e.graph_id AND s.id = e.source JOIN n1 t ON t.graph_id = e.graph_id AND t.id = e.target WHERE e.type = 'contains'),
pin AS (SELECT graph_id, target AS id, count(*) AS n, min(source) AS up FROM c GROUP BY ALL), pout AS (SELECT graph_id, source AS id, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT nn.*, trim(coalesce(title, '')) AS tc, coalesce(i.n, 0) AS parents, coalesce(o.n, 0) AS children FROM nn LEFT JOIN pin i ON i.graph_id = nn.graph_id AND i.id = nn.id LEFT JOIN pout o ON o.graph_id = nn.graph_id AND o.id = nn.id),
q AS (SELECT * FROM ee WHERE type = 'sequence'),
kq AS (SELECT q.*, x.n AS xn, x.up AS xu, y.n AS yn, y.up AS yu FROM q JOIN n1 s ON s.graph_id = q.graph_id AND s.id = q.source JOIN n1 t ON t.graph_id = q.graph_id AND t.id = q.target LEFT JOIN pin x ON x.graph_id = q.graph_id AND x.id = q.source LEFT JOIN pin y ON y.graph_id = q.graph_id AND y.id = q.target),
ok AS (SELECT * FROM kq WHERE xn = 1 AND yn = 1 AND xu = yu),
pl AS (SELECT graph_id, source, target, row_number() OVER (PARTITION BY graph_id, source ORDER BY pos) AS p FROM c),
v AS (
SELECT graph_id, 'duplicate_node_id' AS type, id AS node_id, NULL AS a, NULL AS b FROM r WHERE k > 1
UNION ALL SELECT graph_id, 'invalid_edge_type', NULL, source, target FROM ee WHERE type IS NULL OR type NOT IN ('contains', 'sequence')
UNION ALL SELECT graph_id, 'missing_source_node', NULL, source, target FROM ee WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.graph_id = ee.graph_id AND n1.id = ee.source)
UNION ALL SELECT graph_id, 'missing_target_node', NULL, source, target FROM ee WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.graph_id = ee.graph_id AND n1.id = ee.target)
UNION ALL SELECT graph_id, 'invalid_contains_hierarchy', NULL, source, target FROM c WHERE concat(sk, '>', tk) NOT IN ('COURSE>MODULE', 'COURSE>KC', 'MODULE>UNIT', 'MODULE>KC', 'UNIT>UNIT', 'UNIT>KC')
UNION ALL SELECT graph_id, 'course_root_count', NULL, NULL, NULL FROM nn GROUP BY graph_id HAVING count(*) FILTER (kind = 'COURSE') <> 1
UNION ALL SELECT graph_id, 'missing_node_id', id, NULL, NULL FROM nn WHERE id IS NULL
UNION ALL SELECT graph_id, 'invalid_node_kind', id, NULL, NULL FROM nn WHERE kind NOT IN ('COURSE', 'MODULE', 'UNIT', 'KC')
UNION ALL SELECT graph_id, 'empty_title', id, NULL, NULL FROM a WHERE tc = ''
UNION ALL SELECT graph_id, 'parent_count', id, NULL, NULL FROM a WHERE kind <> 'COURSE' AND parents <> 1
UNION ALL SELECT graph_id, 'course_has_parent', id, NULL, NULL FROM a WHERE kind = 'COURSE' AND parents > 0
UNION ALL SELECT graph_id, 'invalid_page_range', id, NULL, NULL FROM a WHERE page_start > page_end
UNION ALL SELECT graph_id, 'kc_has_children', id, NULL, NULL FROM a WHERE kind = 'KC' AND children > 0
UNION ALL SELECT graph_id, 'empty_unit', id, NULL, NULL FROM a WHERE kind = 'UNIT' AND children = 0
UNION ALL SELECT graph_id, 'empty_module', id, NULL, NULL FROM a WHERE kind = 'MODULE' AND children = 0
UNION ALL SELECT graph_id, 'kc_missing_page_grounding', id, NULL, NULL FROM a WHERE kind = 'KC' AND n_pages = 0 AND page_start IS NULL AND page_end IS NULL
UNION ALL SELECT graph_id, 'invalid_path', id, NULL, NULL FROM a WHERE p1 IS NULL
UNION ALL SELECT graph_id, 'path_title_mismatch', id, NULL, NULL FROM a WHERE p1 IS NOT NULL AND trim(coalesce(p3, p2, p1)) <> tc
UNION ALL SELECT graph_id, 'duplicate_sibling_title', NULL, source, target FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, source, lower(trim(tt)) ORDER BY pos) AS k FROM c) x WHERE k > 1
UNION ALL SELECT graph_id, 'child_starts_before_parent', NULL, source, target FROM c WHERE ts < ss
UNION ALL SELECT graph_id, 'child_ends_after_parent', NULL, source, target FROM c WHERE te > se
UNION ALL SELECT c.graph_id, 'path_parent_prefix_mismatch', NULL, source, target FROM c JOIN pin i ON i.graph_id = c.graph_id AND i.id = c.target AND i.n = 1 WHERE (s1 IS NOT NULL AND s1 IS DISTINCT FROM t1) OR (s2 IS NOT NULL AND s2 IS DISTINCT FROM t2) OR (s3 IS NOT NULL AND s3 IS DISTINCT FROM t3)
UNION ALL SELECT graph_id, 'sequence_self_loop', NULL, source, target FROM q WHERE source = target
UNION ALL SELECT graph_id, 'duplicate_sequence_edge', NULL, source, target FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, source, target ORDER BY pos) AS k FROM q) x WHERE k > 1
UNION ALL SELECT graph_id, 'sequence_not_between_siblings', NULL, source, target FROM kq WHERE NOT coalesce(xn = 1 AND yn = 1 AND xu = yu, FALSE)
UNION ALL SELECT ok.graph_id, 'sequence_not_adjacent', NULL, ok.source, ok.target FROM ok JOIN pl s ON s.graph_id = ok.graph_id AND s.source = ok.xu AND s.target = ok.source JOIN pl t ON t.graph_id = ok.graph_id AND t.source = ok.xu AND t.target = ok.target WHERE t.p <> s.p + 1)
"""


@query(VIOLATIONS + "SELECT graph_id, type, count(*) AS n FROM v GROUP BY ALL")
def violations_by_type(spark, d):
    return V.violations(*bad(spark, d)).filter("type <> 'sequence_cycle'").groupBy("graph_id", "type").agg(F.count("*").alias("n"))


@query(VIOLATIONS + "SELECT graph_id, type, node_id, a, b FROM v")
def violations_detail(spark, d):
    v = V.violations(*bad(spark, d)).filter("type <> 'sequence_cycle'")
    return v.select("graph_id", "type", "node_id", F.coalesce("source", F.when(F.col("type") != "sequence_not_adjacent", F.col("parent_id"))).alias("a"), F.coalesce("target", "child_id").alias("b"))


@query(
    VIOLATIONS.replace("WITH nn", "WITH RECURSIVE nn", 1)
    + ", w AS (SELECT DISTINCT graph_id, xu, source AS root, target AS here FROM ok UNION SELECT w.graph_id, w.xu, w.root, ok.target FROM w JOIN ok ON ok.graph_id = w.graph_id AND ok.xu = w.xu AND ok.source = w.here) SELECT DISTINCT graph_id, xu AS parent_id FROM w WHERE root = here"
)
def sequence_cycles(spark, d):
    return V.violations(*bad(spark, d)).filter("type = 'sequence_cycle'").select("graph_id", "parent_id")


ALL_VIOLATIONS = (
    VIOLATIONS.replace("WITH nn", "WITH RECURSIVE nn", 1)
    + """, w AS (SELECT DISTINCT graph_id, xu, source AS root, target AS here FROM ok UNION SELECT w.graph_id, w.xu, w.root, ok.target FROM w JOIN ok ON ok.graph_id = w.graph_id AND ok.xu = w.xu AND ok.source = w.here),
  every AS (SELECT graph_id, count(*) AS n FROM (SELECT graph_id FROM v UNION ALL SELECT graph_id FROM (SELECT DISTINCT graph_id, xu FROM w WHERE root = here) y) z GROUP BY graph_id)"""
)


@query(
    ALL_VIOLATIONS
    + """ SELECT n_nationkey AS graph_id, n_name AS course_title, (SELECT count(*) FROM nn WHERE nn.graph_id = n_nationkey) AS node_count, (SELECT count(*) FROM ee WHERE ee.graph_id = n_nationkey) AS edge_count,
  coalesce(n, 0) = 0 AS validation_ok, coalesce(n, 0) AS violation_count FROM nation LEFT JOIN every ON graph_id = n_nationkey"""
)
def graph_envelope(spark, d):
    n, e = bad(spark, d)
    o = read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.array().cast("array<int>").alias("ord"), F.col("n_name").alias("title"))
    return G.envelope(n, e, V.violations(n, e), o)


@query(
    ALL_VIOLATIONS
    + """ SELECT nn.graph_id, count(*) AS node_count, (SELECT count(*) FROM ee WHERE ee.graph_id = nn.graph_id) AS edge_count, count(*) FILTER (kind = 'COURSE') AS course, count(*) FILTER (kind = 'MODULE') AS module, count(*) FILTER (kind = 'UNIT') AS unit, count(*) FILTER (kind = 'KC') AS kc,
  count(*) FILTER (CASE WHEN p1 IS NULL THEN 0 ELSE 1 END + CASE WHEN p2 IS NULL THEN 0 ELSE 1 END + CASE WHEN p3 IS NULL THEN 0 ELSE 1 END = 2) AS top_sections, coalesce(any_value(every.n), 0) = 0 AS validation_ok, coalesce(any_value(every.n), 0) AS violation_count
  FROM nn LEFT JOIN every ON every.graph_id = nn.graph_id GROUP BY nn.graph_id"""
)
def summary_overview(spark, d):
    n, e = bad(spark, d)
    return B.overview(n, e, V.violations(n, e))


# Scoring ----------------------------------------------------------------------------------------


def _pair(spark, d, profile: str = "eval", number=None) -> tuple[E.Canonical, E.Canonical]:
    """A course's graph as gold and one with changes; ``number`` changes the numbers of the prediction."""
    n, e = compiled(spark, d)
    gold = n.withColumn("title", F.concat_ws(". ", "number", "title"))
    m, f = compiled(spark, d, "geo2")
    key = F.col("src_key")
    pred = m.withColumns({"kind": F.when((key > 0) & (key % 17 == 0), "UNIT").otherwise(F.col("kind")), "page_start": F.when((key > 0) & (key % 19 == 0), F.col("page_start") + 1).otherwise(F.col("page_start"))})
    pred = pred if number is None else pred.withColumn("number", number)
    pred = pred.withColumn("evidence_pages", T.page_list(F.col("page_start"), F.col("page_end")))
    pages = lambda x: x.select("graph_id", "pos", "id", F.col("evidence_pages").alias("pages"))
    return E.canonical(gold, e, pages(gold), profile, numbered=False), E.canonical(pred, f, E.predicted_pages(pred, profile), profile)


def _scored() -> str:
    full = "lower(concat(number, '. ', title))"
    return (
        "WITH "
        + _ctes("geo", "g")
        + ", "
        + _ctes("geo2", "h")
        + f""", hq AS (SELECT * REPLACE (CASE WHEN src_key > 0 AND src_key % 17 = 0 THEN 'UNIT' ELSE kind END AS kind, CASE WHEN src_key > 0 AND src_key % 19 = 0 THEN page_start + 1 ELSE page_start END AS page_start) FROM hn),
  hp AS (SELECT *, CASE WHEN page_start <= page_end THEN range(page_start, page_end + 1) WHEN page_start IS NOT NULL THEN [page_start] WHEN page_end IS NOT NULL THEN [page_end] ELSE [] END AS pages FROM hq),
  gt AS (SELECT graph_id, pos, kind, {full} AS t, evidence AS pages FROM gn WHERE kind <> 'COURSE'), ht AS (SELECT graph_id, pos, kind, {full} AS t, pages FROM hp WHERE kind <> 'COURSE'),
  gr AS (SELECT DISTINCT graph_id, 'titles' AS relation, t AS a, '' AS b FROM gt UNION SELECT graph_id, 'title_kind', t, kind FROM gt UNION SELECT graph_id, type, lower(concat(sn, '. ', st)), lower(concat(tn, '. ', tt)) FROM ge WHERE sk <> 'COURSE'),
  hr AS (SELECT DISTINCT graph_id, 'titles' AS relation, t AS a, '' AS b FROM ht UNION SELECT graph_id, 'title_kind', t, kind FROM ht UNION SELECT graph_id, type, lower(concat(sn, '. ', st)), lower(concat(tn, '. ', tt)) FROM he WHERE sk <> 'COURSE'),
  dd AS (SELECT coalesce(g.graph_id, h.graph_id) AS graph_id, coalesce(g.relation, h.relation) AS relation, coalesce(g.a, h.a) AS a, coalesce(g.b, h.b) AS b, g.a IS NOT NULL AS ig, h.a IS NOT NULL AS ih FROM gr g FULL JOIN hr h ON g.graph_id = h.graph_id AND g.relation = h.relation AND g.a = h.a AND g.b = h.b),
  pg AS (SELECT g.graph_id, g.t AS title, CAST(len(list_intersect(g.pages, h.pages)) AS BIGINT) AS tp, CAST(len(h.pages) - len(list_intersect(g.pages, h.pages)) AS BIGINT) AS fp, CAST(len(g.pages) - len(list_intersect(g.pages, h.pages)) AS BIGINT) AS fn, len(g.pages) AS ng, len(h.pages) AS np FROM gt g JOIN ht h ON h.graph_id = g.graph_id AND h.t = g.t)"""
    )


EVAL = _scored()


#: Precision, recall and their harmonic mean from tp, fp and fn.
RATES = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1"


@query(EVAL + f" SELECT graph_id, relation, tp, fp, fn, {RATES}, CAST(tp AS DOUBLE) / CAST(tp + fp + fn AS DOUBLE) AS jaccard FROM (SELECT graph_id, relation, count(*) FILTER (ig AND ih) AS tp, count(*) FILTER (NOT ig) AS fp, count(*) FILTER (NOT ih) AS fn FROM dd GROUP BY ALL) x")
def eval_set_metrics(spark, d):
    return E.set_metrics(*_pair(spark, d))


@query(EVAL + " SELECT graph_id, title, tp, fp, fn, np > 0 AS grounded FROM pg")
def eval_page_grounding(spark, d):
    return E.page_grounding(*_pair(spark, d))


@query(EVAL + f" SELECT graph_id, tp, fp, fn, {RATES}, CAST(grounded AS DOUBLE) / CAST(titles AS DOUBLE) AS grounded_kc_rate FROM (SELECT graph_id, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn, count(*) FILTER (np > 0) AS grounded FROM pg GROUP BY graph_id) m JOIN (SELECT graph_id, count(DISTINCT t) AS titles FROM gt GROUP BY graph_id) k USING (graph_id)")
def eval_page_micro(spark, d):
    return E.page_grounding_micro(*_pair(spark, d))


@query(EVAL + " SELECT g.graph_id, g.kind AS gold, h.kind AS pred, count(*) AS n FROM gt g JOIN ht h ON h.graph_id = g.graph_id AND h.t = g.t GROUP BY ALL")
def eval_kind_confusion(spark, d):
    return E.kind_confusion(*_pair(spark, d))


@query(EVAL + " SELECT *, CAST(correct AS DOUBLE) / CAST(matched_titles AS DOUBLE) AS title_kind_accuracy FROM (SELECT g.graph_id, count(*) AS matched_titles, count(*) FILTER (g.kind = h.kind) AS correct FROM gt g JOIN ht h ON h.graph_id = g.graph_id AND h.t = g.t GROUP BY ALL) x")
def eval_kind_accuracy(spark, d):
    return E.kind_accuracy(*_pair(spark, d))


@query(EVAL + " SELECT graph_id, concat(CASE WHEN ig THEN 'missing_' ELSE 'extra_' END, relation) AS difference, a, b FROM dd WHERE ig <> ih AND relation <> 'title_kind'")
def eval_differences(spark, d):
    return E.differences(*_pair(spark, d))


#: Titles whose numbers differ in the prediction for every 29th customer.
NEAR = EVAL + r""", h2 AS (SELECT DISTINCT graph_id, lower(concat(number, CASE WHEN src_key > 0 AND src_key % 29 = 0 THEN '.7' ELSE '' END, '. ', title)) AS t FROM hp WHERE kind <> 'COURSE'),
  un AS (SELECT coalesce(g.graph_id, h.graph_id) AS graph_id, coalesce(g.t, h.t) AS t, g.t IS NOT NULL AS ig FROM (SELECT DISTINCT graph_id, t FROM gt) g FULL JOIN h2 h ON g.graph_id = h.graph_id AND g.t = h.t WHERE g.t IS NULL OR h.t IS NULL),
  nm AS (SELECT graph_id, regexp_replace(t, '^[0-9.]+\s+', '') AS text_norm, string_agg(t, '|' ORDER BY t) FILTER (ig) AS gold, string_agg(t, '|' ORDER BY t) FILTER (NOT ig) AS pred FROM un GROUP BY ALL HAVING count(*) FILTER (ig) > 0 AND count(*) FILTER (NOT ig) > 0)"""


def _renumbered(spark, d) -> tuple[E.Canonical, E.Canonical]:
    key = F.col("src_key")
    return _pair(spark, d, number=F.when((key > 0) & (key % 29 == 0), F.concat("number", F.lit(".7"))).otherwise(F.col("number")))


@query(NEAR + " SELECT graph_id, text_norm, gold, pred, count(*) OVER (PARTITION BY graph_id) AS count FROM nm")
def eval_near_matches(spark, d):
    m = E.near_matches(*_renumbered(spark, d))
    return m.select("graph_id", "text_norm", F.array_join("gold_candidates", "|").alias("gold"), F.array_join("pred_candidates", "|").alias("pred"), "count")


@query(NEAR + " SELECT graph_id, text_norm, count FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS count, row_number() OVER (PARTITION BY graph_id ORDER BY text_norm) AS k FROM nm) x WHERE k <= 3")
def eval_near_matches_first(spark, d):
    """The first three of each graph, with how many there are."""
    return E.near_matches(*_renumbered(spark, d), most=3).select("graph_id", "text_norm", "count")


@query()
def eval_report(spark, d):
    return E.report(*_pair(spark, d))


@query()
def error_counters(spark, d):
    return R.counters(*_pair(spark, d, "report"), compiled(spark, d)[0])


@query(
    EVAL
    + """ SELECT graph_id, error, count(*) AS n FROM (SELECT graph_id, concat(CASE WHEN ig THEN 'missing_' ELSE 'extra_' END, relation, CASE relation WHEN 'titles' THEN '' ELSE '_edges' END) AS error FROM dd WHERE ig <> ih AND relation <> 'title_kind'
  UNION ALL SELECT g.graph_id, 'wrong_node_kinds' FROM gt g JOIN ht h ON h.graph_id = g.graph_id AND h.t = g.t WHERE g.kind <> h.kind
  UNION ALL SELECT graph_id, 'page_grounding_errors' FROM pg WHERE ng > 0 AND fp + fn > 0) x GROUP BY ALL"""
)
def error_matrix(spark, d):
    """The eight counters under the evaluator's titles, long and without zeros."""
    g, p = _pair(spark, d)
    return R.heatmap(R.counters(g, p, compiled(spark, d)[0])).filter("n > 0").select("graph_id", F.col("counter").alias("error"), "n")


@query(EVAL + " SELECT graph_id, b AS child, bool_or(ig) AS missing, bool_or(ih) AS extra FROM dd WHERE ig <> ih AND relation = 'contains' AND a IN ('1.1. automobile', '2.1. automobile') GROUP BY ALL")
def focus_children(spark, d):
    return R.focus_children(E.differences(*_pair(spark, d)), ["1.1. automobile", "2.1. automobile"])


@query(
    EVAL
    + """ SELECT * FROM (SELECT graph_id, b AS child, bool_or(ig AND a = '1.1. automobile') AS missing, bool_or(ih AND a = '1.1. automobile') AS extra, bool_or(ih AND a = '2.1. automobile') AS extra_elsewhere
  FROM dd WHERE ig <> ih AND relation = 'contains' GROUP BY ALL) x WHERE missing OR extra OR extra_elsewhere"""
)
def attachment_edges(spark, d):
    return R.attachment_edges(E.differences(*_pair(spark, d)), "1.1. automobile", "2.1. automobile")


@query(
    EVAL
    + """, st AS (SELECT t, graph_id, bool_or(ig AND NOT ih) AS missing, bool_or(ih AND NOT ig) AS extra FROM (SELECT graph_id, a AS t, ig, ih FROM dd WHERE relation = 'titles') x GROUP BY ALL),
  wk AS (SELECT g.graph_id, g.t, string_agg(DISTINCT g.kind, ', ' ORDER BY g.kind) AS gk, string_agg(DISTINCT h.kind, ', ' ORDER BY h.kind) AS hk FROM gt g JOIN ht h ON h.graph_id = g.graph_id AND h.t = g.t GROUP BY ALL HAVING count(*) FILTER (g.kind = h.kind) = 0)
  SELECT st.graph_id, st.t AS title, CASE WHEN missing THEN 'missing' WHEN extra THEN 'extra' WHEN gk IS NOT NULL THEN 'wrong_kind' ELSE 'matched' END AS style, CASE WHEN gk IS NULL THEN '' ELSE concat('kind: ', gk, ' → ', hk) END AS kinds FROM st LEFT JOIN wk ON wk.graph_id = st.graph_id AND wk.t = st.t"""
)
def figure_styles(spark, d):
    g, p = _pair(spark, d)
    styles = R.node_styles(g.titles.unionByName(p.titles).distinct(), E.differences(g, p), R.wrong_kind_map(E.kind_agreement(g, p)))
    return styles.select("graph_id", "title", "style", F.regexp_extract("label", r"\n(kind: .*)$", 1).alias("kinds"))


# Stability ----------------------------------------------------------------------------------------


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    n, e = compiled(spark, d)
    runs = spark.range(5).select(F.col("id").cast("int").alias("r"))
    m = n.crossJoin(runs).filter((F.col("src_key") < 0) | ((F.col("src_key") * 7 + F.col("r") * 13) % 10 != 0)).withColumn("run_id", F.col("graph_id") * 10 + F.col("r"))
    ends = m.select("run_id", F.col("id").alias("i"))
    f = e.crossJoin(runs).withColumn("run_id", F.col("graph_id") * 10 + F.col("r")).alias("f")
    f = f.join(ends.alias("s"), F.expr("f.run_id = s.run_id AND f.source = s.i"), "left_semi").join(ends.alias("t"), F.expr("f.run_id = t.run_id AND f.target = t.i"), "left_semi")
    return m, f


RUNS = (
    GEO
    + """, rr AS (SELECT CAST(range AS INT) AS r FROM range(5)), rn AS (SELECT gn.*, gn.graph_id * 10 + r AS run_id FROM gn CROSS JOIN rr WHERE src_key < 0 OR (src_key * 7 + r * 13) % 10 <> 0),
  re AS (SELECT e.*, e.graph_id * 10 + r AS run_id FROM ge e CROSS JOIN rr WHERE EXISTS (SELECT 1 FROM rn s WHERE s.run_id = e.graph_id * 10 + r AND s.id = e.source) AND EXISTS (SELECT 1 FROM rn t WHERE t.run_id = e.graph_id * 10 + r AND t.id = e.target)),
  ss AS (SELECT DISTINCT run_id, 'titles' AS key, lower(title) AS a, '' AS b FROM rn UNION SELECT run_id, 'title_kind', lower(title), lower(kind) FROM rn UNION SELECT run_id, type, lower(st), lower(tt) FROM re),
  sz AS (SELECT run_id, key, count(*) AS n FROM ss GROUP BY ALL)"""
)


@query(RUNS + " SELECT *, CAST(2 * \"both\" AS DOUBLE) / CAST(n_a + n_b AS DOUBLE) AS dice FROM (SELECT CAST(x.run_id // 10 AS INT) AS graph_id, x.run_id AS run_a, y.run_id AS run_b, x.key, (SELECT count(*) FROM ss s JOIN ss t ON s.key = t.key AND s.a = t.a AND s.b = t.b WHERE s.run_id = x.run_id AND t.run_id = y.run_id AND s.key = x.key) AS \"both\", x.n AS n_a, y.n AS n_b FROM sz x JOIN sz y ON x.key = y.key AND x.run_id < y.run_id AND x.run_id // 10 = y.run_id // 10) z")
def run_dice(spark, d):
    """Pairs of the five runs on each graph."""
    n, e = _runs(spark, d)
    return Y.pair_dice(Y.run_sets(n, e), n, "graph_id")


def _moments(table: str, name: str) -> str:
    """Mean and population deviation of the rows that each run has in a table."""
    return f"(SELECT CAST(sum(n) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS {name}_mean, sqrt(CAST(sum(n * n) * count(*) - sum(n) * sum(n) AS DOUBLE) / CAST(count(*) * count(*) AS DOUBLE)) AS {name}_std FROM (SELECT run_id, CAST(count(*) AS BIGINT) AS n FROM {table} GROUP BY run_id) x{table}) m{table}"


@query(RUNS + f" SELECT runs, validation_pass_rate, nodes_mean, nodes_std, edges_mean, edges_std FROM {_moments('rn', 'nodes')}, {_moments('re', 'edges')}, (SELECT count(*) AS runs, CAST(count(*) FILTER (run_id % 3 <> 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS validation_pass_rate FROM (SELECT DISTINCT run_id FROM rn) r) k")
def run_stats(spark, d):
    """Every third run counts as one that didn't pass its validation."""
    n, e = _runs(spark, d)
    runs = n.groupBy("run_id").agg(F.count("*").alias("node_count")).join(e.groupBy("run_id").agg(F.count("*").alias("edge_count")), "run_id").withColumn("validation_ok", F.col("run_id") % 3 != 1)
    return Y.run_stats(runs)


@query(
    RUNS
    + """, ds AS (SELECT x.run_id // 10 AS g, x.key, CAST(format('{:.4f}', CAST(2 * (SELECT count(*) FROM ss s JOIN ss t ON s.key = t.key AND s.a = t.a AND s.b = t.b WHERE s.run_id = x.run_id AND t.run_id = y.run_id AND s.key = x.key) AS DOUBLE) / CAST(x.n + y.n AS DOUBLE)) AS DOUBLE) AS d FROM sz x JOIN sz y ON x.key = y.key AND x.run_id < y.run_id AND x.run_id // 10 = y.run_id // 10)
  SELECT CAST(g AS INT) AS graph_id, key, CAST(format('{:.4f}', CAST(sum(CAST(round(d * 10000) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 10000 AS DOUBLE)) AS DOUBLE) AS mean FROM ds GROUP BY ALL"""
)
def run_mean_dice(spark, d):
    n, e = _runs(spark, d)
    return Y.mean_dice(Y.pair_dice(Y.run_sets(n, e), n, "graph_id"), "graph_id")


# Sinks ------------------------------------------------------------------------------------------


@query(
    GEO
    + """ SELECT graph_id, line FROM (SELECT graph_id, concat('  "', id, '" [label="', title, '", shape="', CASE kind WHEN 'UNIT' THEN 'ellipse' WHEN 'KC' THEN 'note' ELSE 'box' END, '", style="', CASE kind WHEN 'COURSE' THEN 'filled,bold' ELSE 'filled' END, '", fillcolor="', CASE kind WHEN 'COURSE' THEN 'lightblue' WHEN 'MODULE' THEN 'lightgreen' WHEN 'UNIT' THEN 'gold' ELSE 'lightpink' END, '"];') AS line FROM gn
  UNION ALL SELECT graph_id, concat('  "', source, '" -> "', target, '" [', CASE type WHEN 'contains' THEN '' ELSE 'style=dashed, ' END, 'label="', type, '"];') FROM ge
  UNION ALL SELECT g.graph_id, p.line FROM (SELECT DISTINCT graph_id FROM gn) g CROSS JOIN (SELECT unnest(['digraph ECG {', '  rankdir=TB;', '  graph [fontsize=10, overlap=false, splines=true];', '  node [fontsize=10];', '  edge [fontsize=9];', '}']) AS line) p) x"""
)
def dot_lines(spark, d):
    return S.dot_lines(*compiled(spark, d)).select("graph_id", "line")


@query(GEO + " SELECT graph_id, pos, id, kind, title, coalesce(number, '') AS number, coalesce(CAST(page_start AS STRING), '') AS page_start, coalesce(CAST(page_end AS STRING), '') AS page_end, array_to_string(path, ' > ') AS path FROM gn")
def node_csv_rows(spark, d):
    return S.node_csv(compiled(spark, d)[0])


@query()
def graph_json(spark, d):
    n, e = compiled(spark, d)
    v = staged(V.violations(n, e), "violations")
    return S.graph_json(n, e, v, G.envelope(n, e, v, X.outline(spark, d, root=True)))
