"""Tables of contents: embedded bookmarks, printed pages, hybrids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T


def embedded_entries(bookmarks: DataFrame) -> DataFrame:
    """TOC entries from (doc_id, order, level, title, page, total_pages): noise and pages out of range go, the order stays as read."""
    t = T.clean_number_spacing("title")
    b = bookmarks.withColumn("t", t).filter((F.col("t") != "") & ~T.is_noise_title("t") & F.col("page").between(F.lit(1), F.col("total_pages")))
    n = T.extract_number("t")
    return b.select("doc_id", "order", "level", T.ensure_number_in_title("t", n).alias("title"), n.alias("number"), "page", "total_pages", F.lit("embedded_toc").alias("source"))


def toc_like_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, toc_lines) of (doc_id, page, text, total_pages): lines 'title page' with a page in range and no noise."""
    each = pages.select("doc_id", "page", "total_pages", F.explode_outer(F.split("text", r"\R")).alias("line"))
    pattern = r"(?Ud)^(.+?)\s+(\d{1,4})$"
    line = T.clean_toc_line("line")
    each = each.withColumn("title", T.clean_text(F.regexp_extract(line, pattern, 1))).withColumn("n", F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).cast("int"))
    return each.groupBy("doc_id", "page").agg(F.count_if(F.col("n").between(F.lit(1), F.col("total_pages")) & ~T.is_noise_title("title")).alias("toc_lines"))


def toc_pages(pages: DataFrame, max_scan_pages: int = 20, min_lines: int = 3) -> DataFrame:
    """(doc_id, page) of the best-scored page, and of the page after it if that has enough lines.

    The page limit is a filter on the scan.
    """
    p = pages.filter(F.col("page") <= max_scan_pages)
    counted = toc_like_lines(p).join(p.select("doc_id", "page", "links", T.page_contains_toc_keyword("text").alias("keyword")), ["doc_id", "page"])
    score = F.when(F.col("keyword"), 5).otherwise(0) + F.least("toc_lines", F.lit(10)) + F.when(F.col("links") >= 3, 3).otherwise(0)
    c = counted.withColumn("score", score).filter(F.col("keyword") | (F.col("toc_lines") >= min_lines))
    best = c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "page"))).filter("rank = 1").select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"))
    near = c.join(best, F.col("doc_id") == F.col("bd"))
    return near.filter((F.col("page") == F.col("bp")) | ((F.col("page") == F.col("bp") + 1) & (F.col("toc_lines") >= min_lines))).select("doc_id", "page", "score", "toc_lines")


def fragments(layouts: DataFrame) -> DataFrame:
    """(doc_id, page, pos, text, x0, y0, x1, y1) from page layouts (doc_id, page, json): text blocks only, spans joined."""
    schema = "blocks array<struct<type:int,lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>>"
    lines = F.flatten(F.transform(F.filter(F.from_json("json", schema)["blocks"], lambda b: b["type"] == 0), lambda b: b["lines"]))
    each = layouts.select("doc_id", "page", F.posexplode(lines).alias("pos", "l"))
    text = T.clean_text(F.array_join(F.transform("l.spans", lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    box = [F.try_element_at("l.bbox", F.lit(k + 1)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return each.select("doc_id", "page", "pos", text.alias("text"), *box).filter("text <> ''")


def group_rows(frags: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """``frags`` with ``row``: fragments in (y0, x0) order join the current row while y0 is within ``tolerance`` of its first.

    A row depends on y0 alone: a fold over a page's distinct y0 keeps only those that open a row, and
    a running count numbers the others. Fragments without y0 are one row, before all others.
    """
    y = frags.select("doc_id", "page", "y0").distinct()
    # A gap beyond the tolerance always opens a row, so a fold never spans one.
    along = Window.partitionBy("doc_id", "page").orderBy("y0")
    parts = y.filter("y0 IS NOT NULL").withColumn("cut", F.when(F.col("y0") - F.lag("y0").over(along) <= tolerance, 0).otherwise(1)).withColumn("part", F.sum("cut").over(along))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        opens = acc["anchor"].isNull() | (x - acc["anchor"] > tolerance)
        return F.when(opens, F.struct(x.alias("anchor"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    listed = parts.groupBy("doc_id", "page", "part").agg(F.array_sort(F.collect_list(F.col("y0").cast("double"))).alias("y"))
    opening = listed.select("doc_id", "page", F.explode(F.aggregate("y", start, step, lambda acc: acc["out"])).alias("y0"), F.lit(1).alias("opens"))
    numbered = y.withColumn("y", F.col("y0").cast("double")).join(opening.withColumnRenamed("y0", "y"), ["doc_id", "page", "y"], "left")
    opens = F.when(F.col("y0").isNull(), 1).otherwise(F.coalesce("opens", F.lit(0)))
    numbered = numbered.withColumn("row", (F.sum(opens).over(along) - 1).cast("int")).select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("y0").alias("at"), "row")
    return frags.join(numbered, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p")) & F.col("y0").eqNullSafe(F.col("at"))).drop("d", "p", "at")


def visual_lines(frags: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """(doc_id, page, line_pos, text, x0, y0, x1, y1): the rows of a page, fragments from left to right."""
    g = group_rows(frags, tolerance).groupBy("doc_id", "page", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "row")) - 1
    return g.withColumn("text", T.clean_number_spacing("text")).filter("text <> ''").select("doc_id", "page", place.alias("line_pos"), "text", "x0", "y0", "x1", "y1")


def indent_clusters(entries: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """(doc_id, cluster, center): distinct rounded x0 of a document, cut where the gap exceeds ``tolerance``; cluster from 1."""
    x = entries.select("doc_id", F.round("x0", 1).alias("x")).filter("x IS NOT NULL").distinct()
    w = Window.partitionBy("doc_id").orderBy("x")
    cut = F.when(F.col("x") - F.lag("x").over(w) > tolerance, 1).otherwise(0)
    c = x.withColumn("cut", cut).withColumn("cluster", F.sum("cut").over(w) + 1)
    return c.groupBy("doc_id", "cluster").agg(F.try_divide(F.sum("x"), F.count("*").cast("double")).alias("center"))


def infer_levels(entries: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """``entries`` (doc_id, order, number, x0) with ``level``: parts of a decimal number, 1 for a roman one, else the nearest indent."""
    centers = indent_clusters(entries, tolerance).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    near = F.array_min(F.transform("centers", lambda c: F.struct(F.abs(c["center"] - F.col("x0")).alias("gap"), c["cluster"].alias("cluster"))))["cluster"]
    n = F.col("number")
    level = F.when(n.rlike(r"^\d+(\.\d+)*$"), F.size(F.split(n, r"\."))).when(n.rlike("^[IVXLCDM]+$"), 1).otherwise(F.coalesce(near, F.lit(1)))
    return entries.join(centers, "doc_id", "left").withColumn("level", level.cast("int")).drop("centers")


def printed_entries(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """TOC entries of (doc_id, page, line_pos, text, x0, y0, total_pages) on selected pages (doc_id, page, toc_pos), in that order."""
    s = selected.select(F.col("doc_id").alias("sd"), F.col("page").alias("sp"), "toc_pos")
    e = lines.join(s, (F.col("doc_id") == F.col("sd")) & (F.col("page") == F.col("sp"))).withColumn("e", T.parse_toc_line("text", F.col("total_pages"))).filter("e IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("toc_pos", "line_pos")) - 1
    e = e.select("doc_id", order.alias("order"), "e.title", "e.number", "e.page", "total_pages", "x0", "y0", F.lit("printed_toc").alias("source"))
    return infer_levels(e)


def select_pages(pages: DataFrame, given: list[int] | None = None, auto_detect: bool = True, max_scan_pages: int = 20) -> DataFrame:
    """(doc_id, page, toc_pos) of the pages to read entries from: the given ones, else those that toc_pages() finds, else none."""
    if given is not None:
        listed = F.posexplode(F.array(*[F.lit(int(p)) for p in given]).cast("array<int>")).alias("toc_pos", "page")
        return pages.select("doc_id").distinct().select("doc_id", listed).select("doc_id", "page", "toc_pos")
    if not auto_detect:
        return pages.select("doc_id", F.col("page").cast("int").alias("page"), F.lit(0).alias("toc_pos")).limit(0)
    found = toc_pages(pages, max_scan_pages)
    return found.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1).alias("toc_pos"))


def entries(embedded: DataFrame, lines: DataFrame, pages: DataFrame, given: list[int] | None = None, prefer_embedded: bool = True, auto_detect: bool = True, max_scan_pages: int = 20) -> DataFrame:
    """TOC entries of each document: embedded ones first if they are preferred, else from printed pages alone."""
    printed = printed_entries(lines, select_pages(pages, given, auto_detect, max_scan_pages))
    return hybrid(embedded if prefer_embedded else embedded.limit(0), printed)


def hybrid(embedded: DataFrame, printed: DataFrame) -> DataFrame:
    """Embedded entries where a document has any, else its printed ones."""
    columns = ["doc_id", "order", "level", "title", "number", "page", "total_pages", "source"]
    has = embedded.select(F.col("doc_id").alias("hd")).distinct()
    return embedded.select(*columns).unionByName(printed.join(has, F.col("doc_id") == F.col("hd"), "left_anti").select(*columns))
