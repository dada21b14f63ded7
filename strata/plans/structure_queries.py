"""Queries on texts, outlines, headings, tables of contents and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import headings as H
from strata.operators import outline as O
from strata.operators import pages as P
from strata.operators import toc as C
from strata.plans import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(o: str = "ord"):
    return F.array_join(F.col(o).cast("array<string>"), ".")


CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(strip_accents(lower(" + CLEAN + r")), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"
SPACED = r"regexp_replace(regexp_replace(regexp_replace({0}, '^(\d+)\s+\.\s+', '\1. '), '^(\d+)\s+\.(\d+)', '\1.\2'), '^(\d+)\.\s+(\d+)', '\1.\2')"
DECIMAL = r"nullif(rtrim(regexp_extract({0}, '^(\d+(?:\.\d+)*\.?)\s+.+$', 1), '.'), '')"
ROMAN = r"nullif(upper(regexp_extract({0}, '(?i)^([IVXLCDM]+)\s*[.\-:]\s+.+$', 1)), '')"
NOISE = r"""(({0}) = '' OR ({0}) IN ('sommaire','table des matieres','table de matieres','table of contents','contents','toc')
  OR regexp_full_match({0}, 'page\s+\d+(\s+sur)?') OR regexp_full_match({0}, 'page\s+\d+\s+sur\s+\d+') OR contains({0}, 'version') OR contains({0}, 'isbn')
  OR contains({0}, 'tous droits reserves') OR regexp_full_match({0}, '[^\p{{L}}]+'))"""


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({X.sql(n)})" for n in names) + " "


# Text -------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({CLEAN.format('text')}) AS clean, CAST(length({CLEAN.format('text')}) AS BIGINT) AS n FROM documents")
def text_clean(spark, d):
    c = T.clean_text("text")
    return read(spark, d, "documents").select("doc_id", F.md5(c).alias("clean"), F.length(c).cast("long").alias("n"))


@query(f"SELECT doc_id, md5({CLEAN.format('replace(lower(' + CLEAN.format('text') + '), chr(8217), chr(39))')}) AS k FROM documents")
def text_normalize_key(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize_key("text")).alias("k"))


@query(f"SELECT conv_id, turn, md5({SLUG.format('text')}) AS slug, CAST(length({SLUG.format('text')}) AS BIGINT) AS n FROM conversations")
def text_slug(spark, d):
    """The slug of the whole text, as its digest and length."""
    s = T.slugify("text")
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(s).alias("slug"), F.length(s).cast("long").alias("n"))


@query("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS folded FROM documents")
def text_strip_accents(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.strip_accents(F.coalesce("text", F.lit("")))).alias("folded"))


@query()
def nfkd_titles(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.fold_compat("text")).alias("folded"))


@query(_with("head") + f"SELECT doc_id, i, coalesce({DECIMAL.format('text')}, {ROMAN.format('text')}) AS number FROM head")
def heading_extract_number(spark, d):
    return X.frame(spark, d, "head").select("doc_id", "i", T.extract_number("text").alias("number"))


@query(_with("flat") + f"SELECT doc_id, i, {SPACED.format('t')} AS spaced FROM (SELECT doc_id, i, concat(CAST(part % 9 AS STRING), CASE supp % 3 WHEN 0 THEN ' . ' WHEN 1 THEN ' .' ELSE '. ' END, CASE WHEN part % 2 = 0 THEN '4 Title' ELSE 'Title' END) AS t FROM flat) s")
def toc_number_spacing(spark, d):
    text = F.concat((F.col("part") % 9).cast("string"), F.when(F.col("supp") % 3 == 0, " . ").when(F.col("supp") % 3 == 1, " .").otherwise(". "), F.when(F.col("part") % 2 == 0, "4 Title").otherwise("Title"))
    return X.frame(spark, d, "flat").select("doc_id", "i", T.clean_number_spacing(text).alias("spaced"))


LINE = r"trim(regexp_replace(regexp_replace(text, '\.{2,}', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    _with("head")
    + rf"""SELECT doc_id, i, CASE WHEN n IS NULL OR regexp_matches(t, '^' || replace(n, '.', '\.') || '[.\s\-:]') THEN t ELSE concat(n, '. ', t) END AS title, page, n AS number
  FROM (SELECT doc_id, i, t, page, coalesce({DECIMAL.format('t')}, {ROMAN.format('t')}) AS n
    FROM (SELECT doc_id, i, regexp_extract(line, '^(.+?)\s+(\d{{1,4}})$', 1) AS t, CAST(nullif(regexp_extract(line, '^(.+?)\s+(\d{{1,4}})$', 2), '') AS INT) AS page
      FROM (SELECT doc_id, i, {LINE} AS line FROM head) a) b WHERE page BETWEEN 1 AND 40 AND NOT {NOISE.format('lower(t)')}) c"""
)
def toc_line_parse(spark, d):
    return X.frame(spark, d, "head").select("doc_id", "i", T.parse_toc_line("text", F.col("total_pages")).alias("e")).filter("e IS NOT NULL").select("doc_id", "i", "e.*")


@query(_with("flat") + f"SELECT doc_id, i, {NOISE.format('t')} AS noise FROM (SELECT doc_id, i, CASE part % 8 WHEN 0 THEN 'contents' WHEN 1 THEN concat('page ', CAST(supp AS STRING)) WHEN 2 THEN concat('page ', CAST(supp AS STRING), ' sur 9') WHEN 3 THEN 'conversion' WHEN 4 THEN CAST(part AS STRING) WHEN 5 THEN 'isbn 1' ELSE concat('part ', CAST(part AS STRING)) END AS t FROM flat) s")
def toc_noise(spark, d):
    p, s = F.col("part"), F.col("supp").cast("string")
    t = F.when(p % 8 == 0, "Contents").when(p % 8 == 1, F.concat(F.lit("Page "), s)).when(p % 8 == 2, F.concat(F.lit("page "), s, F.lit(" sur 9"))).when(p % 8 == 3, "Conversion").when(p % 8 == 4, p.cast("string")).when(p % 8 == 5, "ISBN 1").otherwise(F.concat(F.lit("Part "), p.cast("string")))
    return X.frame(spark, d, "flat").select("doc_id", "i", T.is_noise_title(t).alias("noise"))


@query(
    _with("head")
    + r"""SELECT doc_id, i, kind, CASE kind WHEN 'decimal' THEN rtrim(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '.') WHEN 'roman' THEN regexp_extract(text, '^([IVXLCDM]+)\s*[.\-:]\s+(.+)$', 1) END AS number,
  CASE kind WHEN 'decimal' THEN CAST(1 + length(rtrim(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '.')) - length(replace(rtrim(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1), '.'), '.', '')) AS INT) WHEN 'roman' THEN 1 WHEN 'bullet' THEN 99 END AS depth,
  CASE kind WHEN 'roman' THEN CASE regexp_extract(text, '^([IVXLCDM]+)', 1) WHEN 'I' THEN 1 WHEN 'II' THEN 2 ELSE 3 END END AS roman_index
  FROM (SELECT *, CASE WHEN regexp_full_match(text, '\d+(\.\d+)*\.?\s+.+') THEN 'decimal' WHEN regexp_full_match(text, '[IVXLCDM]+\s*[.\-:]\s+.+') THEN 'roman' WHEN regexp_full_match(text, '-\s+.+') THEN 'bullet' END AS kind FROM head) h"""
)
def heading_classify(spark, d):
    h = T.heading_info("text")
    return X.frame(spark, d, "head").select("doc_id", "i", h.alias("h")).select("doc_id", "i", F.col("h.numbering_type").alias("kind"), "h.number", "h.depth", "h.roman_index")


@query(_with("geo") + "SELECT doc_id, o1, o2, o3, lower(concat(number, '. ', title)) AS eval_title, lower(concat(number, ' ', title)) AS report_title, lower(title) AS body FROM geo")
def title_profiles(spark, d):
    return X.frame(spark, d, "geo").select("doc_id", "o1", "o2", "o3", T.eval_heading_full("title", "number").alias("eval_title"), T.report_title("title", "number").alias("report_title"), T.eval_heading_text_only("title", "number").alias("body"))


@query(_with("geo") + "SELECT doc_id, o1, o2, o3, concat('KC_', substring(sha1(concat_ws('||', title, number, coalesce(CAST(start_page AS STRING), ''))), 1, 12)) AS id FROM geo")
def stable_ids(spark, d):
    return X.frame(spark, d, "geo").select("doc_id", "o1", "o2", "o3", T.stable_id("KC", F.col("title"), F.col("number"), F.coalesce(F.col("start_page").cast("string"), F.lit(""))).alias("id"))


@query(
    _with("geo")
    + """SELECT doc_id, o1, o2, o3, CASE WHEN start_page <= end_page THEN array_to_string(range(start_page, end_page + 1), ',') ELSE coalesce(CAST(coalesce(start_page, end_page) AS STRING), '') END AS listed,
  CASE WHEN start_page IS NULL THEN '' ELSE array_to_string(range(start_page, greatest(start_page, coalesce(end_page, start_page)) + 1), ',') END AS predicted FROM geo"""
)
def page_lists(spark, d):
    s, e = F.col("start_page"), F.col("end_page")
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return X.frame(spark, d, "geo").select("doc_id", "o1", "o2", "o3", text(T.page_list(s, e)).alias("listed"), text(T.predicted_pages(F.array().cast("array<int>"), s, e)).alias("predicted"))


# Outlines ---------------------------------------------------------------------------------------

ORD = "concat(CAST(o1 AS STRING), CASE WHEN o2 > 0 THEN concat('.', CAST(o2 AS STRING)) ELSE '' END, CASE WHEN o3 > 0 THEN concat('.', CAST(o3 AS STRING)) ELSE '' END)"
UNDER = "a.doc_id = d.doc_id AND a.o1 = d.o1 AND (a.o2 = 0 OR a.o2 = d.o2) AND (a.o3 = 0 OR a.o3 = d.o3)"
SPANS = f"""s AS (SELECT a.doc_id, a.o1, a.o2, a.o3, min(d.start_page) AS s, count(d.end_page) > 0 AS has_end FROM {{0}} a JOIN {{0}} d ON {UNDER} GROUP BY ALL),
e AS (SELECT g.doc_id, g.o1, g.o2, g.o3, greatest(g.end_page, CASE WHEN has_end THEN s END) AS e FROM {{0}} g JOIN s USING (doc_id, o1, o2, o3)),
m AS (SELECT a.doc_id, a.o1, a.o2, a.o3, max(d.e) AS e FROM {{0}} a JOIN e d ON {UNDER} GROUP BY ALL)"""


@query(_with("geo") + f", {SPANS.format('geo')} SELECT doc_id, {ORD} AS ord, s AS start_page, e AS end_page FROM s JOIN m USING (doc_id, o1, o2, o3)")
def outline_spans(spark, d):
    return O.recompute_spans(X.outline(spark, d)).filter("size(ord) > 0").select("doc_id", key().alias("ord"), "start_page", "end_page")


@query(
    _with("dup")
    + f"""SELECT doc_id, {ORD} AS ord, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, o1, o2, (o2 = 0), (o3 = 0), lower(number), lower(title), start_page, end_page ORDER BY o3, o2, o1) AS r FROM dup) x WHERE r = 1"""
)
def outline_dedupe_siblings(spark, d):
    return O.dedupe_siblings(X.outline(spark, d, "dup")).select("doc_id", key().alias("ord"), "title")


@query(_with("geo") + "SELECT doc_id, count(*) AS total, count(*) FILTER (o3 > 0) AS leaves, CAST(max(CASE WHEN o3 > 0 THEN 3 WHEN o2 > 0 THEN 2 ELSE 1 END) AS BIGINT) AS max_depth, count(*) FILTER (o2 = 0) AS top_level FROM geo GROUP BY doc_id")
def outline_summary(spark, d):
    return O.summarize(X.outline(spark, d))


PATHS = """SELECT g.doc_id, g.o1, g.o2, g.o3, concat(a.number, ' ', a.title, CASE WHEN g.o2 > 0 THEN concat(' > ', b.number, ' ', b.title) ELSE '' END, CASE WHEN g.o3 > 0 THEN concat(' > ', g.number, ' ', g.title) ELSE '' END) AS path
  FROM {0} g JOIN {0} a ON a.doc_id = g.doc_id AND a.o1 = g.o1 AND a.o2 = 0 LEFT JOIN {0} b ON b.doc_id = g.doc_id AND b.o1 = g.o1 AND b.o2 = g.o2 AND b.o3 = 0 AND g.o2 > 0"""


@query(_with("geo") + f"SELECT doc_id, {ORD} AS ord, path FROM ({PATHS.format('geo')}) p")
def outline_paths(spark, d):
    return O.paths(X.outline(spark, d)).select("doc_id", key().alias("ord"), "path")


@query(_with("geo", "geo2") + f", p AS ({PATHS.format('geo')}), q AS ({PATHS.format('geo2')}) SELECT doc_id, path, 'removed' AS change FROM (SELECT doc_id, path FROM p EXCEPT SELECT doc_id, path FROM q) x UNION ALL SELECT doc_id, path, 'added' FROM (SELECT doc_id, path FROM q EXCEPT SELECT doc_id, path FROM p) y")
def outline_diff(spark, d):
    return O.diff(X.outline(spark, d), X.outline(spark, d, "geo2"))


@query(_with("geo", "geo2") + "SELECT doc_id, n_before, n_after, n_after - n_before AS delta FROM (SELECT doc_id, count(*) AS n_before FROM geo GROUP BY doc_id) a JOIN (SELECT doc_id, count(*) AS n_after FROM geo2 GROUP BY doc_id) b USING (doc_id)")
def outline_diff_counts(spark, d):
    return O.diff_counts(X.outline(spark, d), X.outline(spark, d, "geo2"))


@query()
def outline_normalize_two_passes(spark, d):
    return O.normalize(X.outline(spark, d, "dup", root=True), passes=2).select("doc_id", key().alias("ord"), "title", "start_page", "end_page")


@query(_with("geo") + f"SELECT doc_id, {ORD} AS ord, title, number, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page FROM geo UNION ALL SELECT DISTINCT doc_id, '', 'Course', NULL, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM geo")
def outline_flatten(spark, d):
    """JSON trees of the courses, built and flattened again."""
    g = X.frame(spark, d, "geo")
    sec = lambda kids: F.struct("title", "number", "start_page", "end_page", *([kids.alias("sections")] if kids is not None else []))
    of = lambda x, k: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), x.alias("x")))), lambda r: r["x"])
    low = g.filter("o3 > 0").groupBy("doc_id", "o1", "o2").agg(of(sec(None), "o3").alias("kids"))
    mid = g.filter("o2 > 0 AND o3 = 0").join(low, ["doc_id", "o1", "o2"], "left").groupBy("doc_id", "o1").agg(of(sec(F.col("kids")), "o2").alias("kids"))
    top = g.filter("o2 = 0").join(mid, ["doc_id", "o1"], "left").groupBy("doc_id").agg(of(sec(F.col("kids")), "o1").alias("sections"))
    trees = top.select("doc_id", F.to_json(F.struct(F.lit("Course").alias("title"), "sections")).alias("json"))
    return O.flatten_outlines(trees).select("doc_id", key().alias("ord"), "title", "number", "start_page", "end_page")


@query(_with("flat") + "SELECT f.doc_id, f.i, (SELECT max(g.i) FROM flat g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.level < f.level) AS parent FROM flat f")
def nest_by_level(spark, d):
    return O.nest_by_level(X.frame(spark, d, "flat")).select("doc_id", "i", "parent")


@query(
    _with("flat")
    + """SELECT doc_id, i, CASE WHEN s IS NULL THEN total_pages ELSE greatest(start_page, s - 1) END AS end_page FROM (
  SELECT f.doc_id, f.i, f.start_page, f.total_pages, min_by(g.start_page, g.i) AS s FROM flat f LEFT JOIN flat g ON g.doc_id = f.doc_id AND g.i > f.i AND g.level <= f.level GROUP BY ALL) x"""
)
def end_page_by_level(spark, d):
    return O.end_page_by_level(X.frame(spark, d, "flat")).select("doc_id", "i", "end_page")


@query(
    _with("head")
    + f""", p AS (SELECT f.doc_id, f.i, (SELECT max(g.i) FROM head g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.level < f.level) AS parent, (SELECT min_by(g.start_page, g.i) FROM head g WHERE g.doc_id = f.doc_id AND g.i > f.i AND g.level <= f.level) AS nxt FROM head f),
  s AS (SELECT p.doc_id, p.i, p.parent, p.nxt, CAST(count(q.i) AS STRING) AS k FROM p JOIN p q ON q.doc_id = p.doc_id AND q.parent IS NOT DISTINCT FROM p.parent AND q.i <= p.i GROUP BY ALL)
  SELECT h.doc_id, concat_ws('.', c.k, b.k, a.k) AS ord, {SLUG.format('h.text')} AS slug, h.text AS title, coalesce({DECIMAL.format('h.text')}, {ROMAN.format('h.text')}) AS number, CASE WHEN a.nxt IS NULL THEN total_pages ELSE greatest(start_page, a.nxt - 1) END AS end_page
  FROM head h JOIN s a ON a.doc_id = h.doc_id AND a.i = h.i LEFT JOIN s b ON b.doc_id = a.doc_id AND b.i = a.parent LEFT JOIN s c ON c.doc_id = b.doc_id AND c.i = b.parent"""
)
def hierarchical_outline(spark, d):
    e = X.frame(spark, d, "head").withColumnRenamed("text", "title").withColumn("number", T.extract_number("title"))
    return O.hierarchical_outline(e).select("doc_id", key().alias("ord"), "slug", "title", "number", "end_page")


FIRST_END = "SELECT doc_id, o1, o2, o3, CASE WHEN start_page IS NOT NULL THEN greatest(start_page, coalesce(nxt - 1, 99)) END AS e FROM (SELECT *, first_value(start_page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o1, o2, o3 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM geo) x"


@query(_with("geo") + f"SELECT doc_id, {ORD} AS ord, e AS end_page FROM ({FIRST_END}) y")
def end_page_preorder(spark, d):
    return O.end_pages_preorder(X.outline(spark, d), F.lit(99)).select("doc_id", key().alias("ord"), "end_page")


@query(
    _with("geo")
    + f""", l AS ({FIRST_END}), two AS (SELECT a.doc_id, a.o1, a.o2, a.o3, CASE WHEN a.o2 > 0 AND a.o3 = 0 THEN coalesce((SELECT max(d.e) FROM l d WHERE d.doc_id = a.doc_id AND d.o1 = a.o1 AND d.o2 = a.o2 AND d.o3 > 0), a.e) ELSE a.e END AS e FROM l a),
  one AS (SELECT a.doc_id, a.o1, a.o2, a.o3, CASE WHEN a.o2 = 0 THEN coalesce((SELECT max(d.e) FROM two d WHERE d.doc_id = a.doc_id AND d.o1 = a.o1 AND d.o2 > 0 AND d.o3 = 0), a.e) ELSE a.e END AS e FROM two a)
  SELECT doc_id, {ORD} AS ord, e AS end_page FROM one"""
)
def parent_end_override(spark, d):
    return O.parent_ends(O.end_pages_preorder(X.outline(spark, d), F.lit(99))).select("doc_id", key().alias("ord"), "end_page")


# Headings ---------------------------------------------------------------------------------------


def _flat_headings(spark, d) -> DataFrame:
    h = X.frame(spark, d, "head").withColumn("h", T.heading_info("text"))
    return h.select("doc_id", "i", F.col("h.number").alias("number"), F.col("h.numbering_type").alias("numbering_type"), F.coalesce("h.depth", "level").alias("depth"), F.col("h.roman_index").alias("roman_index"), "start_page")


KINDS = r"""k AS (SELECT doc_id, i, level, CASE WHEN regexp_full_match(text, '\d+(\.\d+)*\.?\s+.+') THEN 'decimal' WHEN regexp_full_match(text, '[IVX]+ - .+') THEN 'roman' WHEN regexp_full_match(text, '- .+') THEN 'bullet' END AS kind,
  rtrim(regexp_extract(text, '^(\d+(?:\.\d+)*\.?)\s', 1), '.') AS num, CASE regexp_extract(text, '^([IVX]+) - ', 1) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 END AS roman FROM head)"""


@query(
    _with("head")
    + ", "
    + KINDS
    + r"""SELECT f.doc_id, f.i, CASE f.kind WHEN 'roman' THEN NULL
  WHEN 'decimal' THEN coalesce((SELECT max(g.i) FROM k g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.kind = 'decimal' AND contains(f.num, '.') AND g.num = regexp_extract(f.num, '^(.*)\.[^.]*$', 1)),
    (SELECT max(g.i) FROM k g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.roman = TRY_CAST(split_part(f.num, '.', 1) AS INT)))
  WHEN 'bullet' THEN (SELECT max(g.i) FROM k g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.kind IS DISTINCT FROM 'bullet')
  ELSE (SELECT max(g.i) FROM k g WHERE g.doc_id = f.doc_id AND g.i < f.i AND g.kind IS DISTINCT FROM 'bullet'
    AND g.i >= coalesce((SELECT max(n.i) FROM k n WHERE n.doc_id = f.doc_id AND n.i < f.i AND n.kind IN ('decimal', 'roman')), -1)
    AND CASE g.kind WHEN 'roman' THEN 1 WHEN 'decimal' THEN 1 + length(g.num) - length(replace(g.num, '.', '')) ELSE g.level END < f.level) END AS parent FROM k f"""
)
def heading_hierarchy(spark, d):
    return H.heading_parents(_flat_headings(spark, d)).select("doc_id", "i", "parent")


@query(
    _with("head") + ", " + KINDS + "SELECT doc_id, i FROM (SELECT *, min(CASE WHEN kind IN ('decimal', 'roman') THEN i END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN kind IN ('decimal', 'roman') THEN i END) OVER (PARTITION BY doc_id) AS hi FROM k) x WHERE kind IS NOT NULL OR lo IS NULL OR i < lo OR i > hi"
)
def drop_isolated_unnumbered(spark, d):
    return H.drop_isolated_unnumbered(_flat_headings(spark, d)).select("doc_id", "i")


WALK = """i AS (SELECT doc_id, self_ref AS ref, parent_ref AS up, label, name FROM items),
  w AS (SELECT doc_id, self_ref, parent_ref AS ref, [parent_ref] AS seen FROM items WHERE collection = 'texts' AND parent_ref IS NOT NULL
    UNION ALL SELECT w.doc_id, w.self_ref, i.up, list_append(w.seen, i.up) FROM w JOIN i ON w.doc_id = i.doc_id AND w.ref = i.ref WHERE i.up IS NOT NULL AND NOT list_contains(w.seen, i.up)),
  loc AS (SELECT DISTINCT w.doc_id, w.self_ref FROM w LEFT JOIN i ON w.doc_id = i.doc_id AND w.ref = i.ref
    WHERE starts_with(w.ref, '#/tables/') OR starts_with(w.ref, '#/pictures/') OR i.label IN ('key_value_area', 'form_area') OR starts_with(i.name, 'rich_cell_group'))"""


@query(f"WITH RECURSIVE items AS ({X.sql('items')}), {WALK} SELECT DISTINCT doc_id, self_ref, ref FROM w")
def ancestor_closure(spark, d):
    return H.ancestors(X.frame(spark, d, "items"))


@query(f"WITH RECURSIVE items AS ({X.sql('items')}), {WALK} SELECT doc_id, self_ref FROM loc")
def ancestor_exclusion(spark, d):
    return H.local_areas(X.frame(spark, d, "items"))


@query(_with("items") + r"SELECT doc_id, idx, coalesce(page_no, carried) AS page FROM (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM (SELECT *, CAST(nullif(regexp_extract(text, '^PAGE (\d+)$', 1), '') AS INT) AS marker FROM items WHERE collection = 'texts') a) b WHERE marker IS NULL")
def page_forward_fill(spark, d):
    return H.forward_pages(X.frame(spark, d, "items").filter("collection = 'texts'")).select("doc_id", "idx", "page")


@query(f"WITH RECURSIVE items AS ({X.sql('items')}), {WALK} SELECT t.doc_id, t.idx FROM items t WHERE t.collection = 'texts' AND t.label = 'section_header' AND NOT regexp_matches(t.text, '^PAGE ') AND NOT EXISTS (SELECT 1 FROM loc WHERE loc.doc_id = t.doc_id AND loc.self_ref = t.self_ref)")
def heading_candidates(spark, d):
    return H.candidates(X.frame(spark, d, "items")).select("doc_id", "idx")


@query()
def headings_outline(spark, d):
    return H.headings_outline(X.frame(spark, d, "items"), total_pages=200).select("doc_id", key().alias("ord"), "id", "title", "start_page", "end_page")


@query(
    f"""WITH RECURSIVE r AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS idx, {SLUG.format('split_part(p_name, chr(32), 1)')} AS base, row_number() OVER (PARTITION BY p_partkey % 20, {SLUG.format('split_part(p_name, chr(32), 1)')} ORDER BY p_partkey) AS k FROM part)
  SELECT doc_id, CAST(idx AS BIGINT) AS idx, CASE WHEN k = 1 THEN base ELSE concat(base, '-', CAST(k AS STRING)) END AS id FROM r"""
)
def unique_ids(spark, d):
    """Ids of first words, which repeat and hold no numbers."""
    return H.unique_ids(read(spark, d, "part").select((F.col("p_partkey") % 20).alias("doc_id"), F.col("p_partkey").alias("idx"), T.slugify(F.split("p_name", " ")[0]).alias("base")))


# Tables of contents -------------------------------------------------------------------------------



def _toc_pages(spark, d) -> DataFrame:
    h = X.frame(spark, d, "head").withColumn("doc_id", F.col("doc_id") % 40).withColumn("page", (1 + F.col("i") % 30).cast("int"))
    return h.groupBy("doc_id", "page").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"), F.max(F.col("i") % 5).cast("int").alias("links")).withColumn("total_pages", F.lit(60))


TOC_LINES = rf"""p AS (SELECT doc_id % 40 AS doc_id, CAST(1 + i % 30 AS INT) AS page, text, CAST(i % 5 AS INT) AS l FROM head),
  c AS (SELECT doc_id, page, count(*) FILTER (n BETWEEN 1 AND 60 AND NOT {NOISE.format('lower(t)')}) AS toc_lines, max(l) AS links FROM (
    SELECT doc_id, page, l, regexp_extract({LINE}, '^(.+?)\s+(\d{{1,4}})$', 1) AS t, CAST(nullif(regexp_extract({LINE}, '^(.+?)\s+(\d{{1,4}})$', 2), '') AS INT) AS n FROM p) x GROUP BY doc_id, page)"""


@query(_with("head") + ", " + TOC_LINES + "SELECT doc_id, page, toc_lines FROM c")
def toc_like_lines(spark, d):
    return C.toc_like_lines(_toc_pages(spark, d))


@query(
    _with("head")
    + ", "
    + TOC_LINES
    + """, s AS (SELECT *, least(toc_lines, 10) + CASE WHEN links >= 3 THEN 3 ELSE 0 END AS score FROM c WHERE page <= 20 AND toc_lines >= 3),
  b AS (SELECT doc_id AS bd, page AS bp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) AS r FROM s) x WHERE r = 1)
  SELECT doc_id, page, CAST(score AS BIGINT) AS score, toc_lines FROM s JOIN b ON doc_id = bd WHERE page = bp OR page = bp + 1"""
)
def toc_page_topk(spark, d):
    return C.toc_pages(_toc_pages(spark, d)).select("doc_id", "page", F.col("score").cast("long").alias("score"), "toc_lines")


@query(
    f"""WITH RECURSIVE frag AS ({X.sql('frag')}), o AS (SELECT doc_id, page, pos, y0, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos) AS k FROM frag),
  r AS (SELECT doc_id, page, pos, k, y0 AS anchor, 0 AS "row" FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.page, o.pos, o.k, CASE WHEN o.y0 - r.anchor > 8 THEN o.y0 ELSE r.anchor END, CASE WHEN o.y0 - r.anchor > 8 THEN r."row" + 1 ELSE r."row" END FROM r JOIN o ON o.doc_id = r.doc_id AND o.page = r.page AND o.k = r.k + 1)
  SELECT doc_id, page, pos, "row" FROM r"""
)
def row_grouping(spark, d):
    return C.group_rows(X.frame(spark, d, "frag")).select("doc_id", "page", "pos", "row")


@query(
    f"""WITH RECURSIVE frag AS ({X.sql('frag')}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos) AS k FROM frag),
  r AS (SELECT doc_id, page, k, y0 AS anchor, 0 AS g FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.page, o.k, CASE WHEN o.y0 - r.anchor > 8 THEN o.y0 ELSE r.anchor END, CASE WHEN o.y0 - r.anchor > 8 THEN r.g + 1 ELSE r.g END FROM r JOIN o ON o.doc_id = r.doc_id AND o.page = r.page AND o.k = r.k + 1),
  l AS (SELECT o.doc_id, o.page, r.g, string_agg(o.text, ' ' ORDER BY o.x0, o.pos, o.text) AS text, min(o.x0) AS x0, min(o.y0) AS y0, max(o.x1) AS x1, max(o.y1) AS y1 FROM o JOIN r ON r.doc_id = o.doc_id AND r.page = o.page AND r.k = o.k GROUP BY ALL)
  SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, g) - 1 AS INT) AS line_pos, md5(text) AS text, x0, y0, x1, y1 FROM l"""
)
def visual_lines(spark, d):
    return C.visual_lines(X.frame(spark, d, "frag")).withColumn("text", F.md5("text"))


@query(_with("frag") + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x0) AS BIGINT) AS cluster, x0 AS center FROM (SELECT DISTINCT doc_id, x0 FROM frag) x")
def indent_clusters(spark, d):
    return C.indent_clusters(X.frame(spark, d, "frag")).select("doc_id", F.col("cluster").cast("long").alias("cluster"), "center")


@query(_with("frag") + """, c AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) AS cluster FROM (SELECT DISTINCT doc_id, x0 FROM frag) x)
  SELECT f.doc_id, f.page, f.pos, CAST(CASE f.pos % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE c.cluster END AS INT) AS level FROM frag f JOIN c USING (doc_id, x0)""")
def indent_levels(spark, d):
    f = X.frame(spark, d, "frag").withColumn("number", F.when(F.col("pos") % 4 == 0, "3.1").when(F.col("pos") % 4 == 1, "IV"))
    return C.infer_levels(f).select("doc_id", "page", "pos", "level")


def _entries(spark, d) -> tuple[DataFrame, DataFrame]:
    h = X.frame(spark, d, "head").withColumn("doc_id", F.col("doc_id") % 200).withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "i", "start_page")) - 1)
    marks = h.filter("doc_id % 3 = 0").select("doc_id", "order", "level", F.col("text").alias("title"), F.col("start_page").alias("page"), "total_pages")
    lines = h.select("doc_id", F.lit(2).alias("page"), F.col("order").alias("line_pos"), "text", (72.0 + 18 * F.col("level")).alias("x0"), F.lit(0.0).alias("y0"), F.lit(60).alias("total_pages"))
    chosen = h.select("doc_id", F.lit(2).alias("page"), F.lit(0).alias("toc_pos")).distinct()
    return C.embedded_entries(marks), C.printed_entries(lines, chosen)


@query()
def toc_hybrid(spark, d):
    return C.hybrid(*_entries(spark, d))


# Pages ------------------------------------------------------------------------------------------


@query(_with("ocr") + 'SELECT doc_id, pos, CAST(coalesce("index", pos + 1) + CASE WHEN min("index") OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END AS INT) AS page_number FROM ocr')
def page_numbering(spark, d):
    return P.number_pages(X.frame(spark, d, "ocr")).select("doc_id", "pos", "page_number")


@query(
    _with("ocr")
    + r"""SELECT doc_id, md5(regexp_replace(string_agg(concat(chr(10), chr(10), '# PAGE ', CAST(n AS STRING), chr(10), chr(10), coalesce(markdown, '')), chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g')) AS blob
  FROM (SELECT *, coalesce("index", pos + 1) + CASE WHEN min("index") OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END AS n FROM ocr) x GROUP BY doc_id"""
)
def page_blob(spark, d):
    return P.page_blob(P.number_pages(X.frame(spark, d, "ocr"))).select("doc_id", F.md5("blob").alias("blob"))


@query("SELECT l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS input_tokens, CAST(l_suppkey AS BIGINT) AS output_tokens, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + l_suppkey ELSE 7 END AS BIGINT) AS total_tokens FROM lineitem")
def token_usage(spark, d):
    l = read(spark, d, "lineitem")
    j = F.to_json(F.struct(F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.when(F.col("l_linenumber") % 2 != 0, 7).alias("total_tokens")))
    return P.token_usage(l.select(F.col("l_orderkey").alias("doc_id"), j.alias("json")), "openai")


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE concat('{\"k\":', CAST(c_custkey AS STRING), '}') END AS json FROM customer")
def lenient_json(spark, d):
    k = F.concat(F.lit('{"k":'), F.col("c_custkey").cast("string"), F.lit("}"))
    t = F.when(F.col("c_custkey") % 3 == 0, k).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Here it is:\n"), k, F.lit("\nDone"))).otherwise("none {")
    return P.lenient_json(read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), t.alias("text"))).select("doc_id", "json")
