"""Outline trees as rows: (doc_id, ord ARRAY<INT>, title, number, role, start_page, end_page).

``ord`` is the path of sibling positions from 1; the parent's is ``ord`` without its last part, the
root's is empty, and arrays order in preorder. Every operator partitions by doc_id once: later
groupings and joins of an outline on (doc_id, ...) keep that partitioning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.functions import text as T


def parent(ord_: str | F.Column = "ord"):
    o = F.col(ord_) if isinstance(ord_, str) else ord_
    return F.slice(o, F.lit(1), F.greatest(F.size(o) - 1, F.lit(0)))


def with_ancestors(nodes: DataFrame, *, own: bool = True, root: bool = False) -> DataFrame:
    """A row for each node and each of its ancestors (``anc``), the node itself included if ``own``."""
    last = F.size("ord") if own else F.size("ord") - 1
    first = F.lit(0 if root else 1)
    steps = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return nodes.withColumn("k", F.explode(steps)).withColumn("anc", F.slice("ord", F.lit(1), F.col("k"))).drop("k")


def flatten_outlines(outlines: DataFrame) -> DataFrame:
    """Outline rows from (doc_id, json): each section of the tree in preorder, the root with an empty ord.

    Integer pages stay, any other value becomes null; a boolean is no integer here. A text that is no JSON
    object has no rows.
    """
    kind = outlines.schema["doc_id"].dataType.simpleString()

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for row in _sections(text):
                    at.append(k)
                    rows.append(row)
                    if len(rows) >= 50_000:
                        yield _flat_batch(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield _flat_batch(batch, at, rows)

    return outlines.select("doc_id", "json").mapInArrow(flat, f"doc_id {kind}, ord array<int>, title string, number string, role string, start_page bigint, end_page bigint")


def _flat_batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "ord", "title", "number", "role", "start_page", "end_page"])


def _sections(text: str | None) -> Iterator[tuple]:
    """(ord, title, number, role, start_page, end_page) of a tree's sections in preorder."""
    try:
        tree = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return
    page = lambda x: x if type(x) is int and -(2**63) <= x < 2**63 else None
    word = lambda x: str(x) if x else None
    todo = [([], tree)] if isinstance(tree, dict) else []
    while todo:
        at, node = todo.pop()
        yield at, *(word(node.get(k)) for k in ("title", "number", "role")), page(node.get("start_page")), page(node.get("end_page"))
        below = node.get("sections")
        kids = [x for x in below if isinstance(x, dict)] if isinstance(below, list) else []
        todo += [([*at, k], kids[k - 1]) for k in range(len(kids), 0, -1)]


def _spread(rows: DataFrame, name: str, value, agg=F.max) -> DataFrame:
    """On rows of with_ancestors(): what the ancestor's own row has as ``value``, on each row of its subtree."""
    return rows.withColumn(name, agg(F.when(F.col("ord") == F.col("anc"), value)).over(Window.partitionBy("doc_id", "anc")))


def drop_flagged(nodes: DataFrame, flag) -> DataFrame:
    """Without the nodes that ``flag`` holds for and all that stands below them. One shuffle by document."""
    columns = nodes.columns
    rows = _spread(with_ancestors(nodes.repartition("doc_id").withColumn("flag", F.coalesce(flag, F.lit(False))), root=True), "gone", F.col("flag"))
    rows = rows.withColumn("gone", F.max(F.coalesce("gone", F.lit(False))).over(Window.partitionBy("doc_id", "ord")))
    return rows.filter((F.col("ord") == F.col("anc")) & ~F.col("gone")).select(*columns)


def dedupe_siblings(nodes: DataFrame) -> DataFrame:
    """The first of siblings with equal number, title and pages stays; later ones go with their children."""
    w = Window.partitionBy("doc_id", "up", "kn", "kt", "start_page", "end_page").orderBy("ord")
    keyed = nodes.repartition("doc_id").withColumns({"up": parent(), "kn": T.normalize_key("number"), "kt": T.normalize_key("title")}).withColumn("rank", F.row_number().over(w))
    return drop_flagged(keyed, (F.col("rank") > 1) & (F.size("ord") > 0)).select(*nodes.columns)


def clean_sections(nodes: DataFrame) -> DataFrame:
    """Clean texts; a section without a title goes with its subtree; an empty number or role is null."""
    c = nodes.withColumns({"title": T.clean_text("title"), "number": F.nullif(T.clean_text("number"), F.lit("")), "role": F.nullif(T.clean_text("role"), F.lit(""))})
    c = c.withColumn("title", F.when((F.size("ord") == 0) & (F.col("title") == ""), "Untitled Course").otherwise(F.col("title")))
    return drop_flagged(c, F.col("title") == "")


def recompute_spans(nodes: DataFrame) -> DataFrame:
    """Pages of each node from its subtree: the least start, and the greatest end where every end was first raised to its own subtree's start.

    With S the least start of a subtree, end(n) is the maximum over d in subtree(n) of d's own end and,
    where d's subtree has any end, S(d). All windows lie inside a document, so one shuffle serves them.
    """
    below, own = Window.partitionBy("doc_id", "anc"), Window.partitionBy("doc_id", "ord")
    rows = with_ancestors(nodes.repartition("doc_id"), root=True)
    rows = rows.withColumns({"s": F.min("start_page").over(below), "has_end": F.max(F.col("end_page").isNotNull()).over(below)})
    rows = rows.withColumn("e", F.max(F.when(F.col("ord") == F.col("anc"), F.greatest("end_page", F.when(F.col("has_end"), F.col("s"))))).over(own))
    rows = rows.withColumn("e", F.max("e").over(below)).filter(F.col("ord") == F.col("anc"))
    return rows.withColumns({"start_page": F.col("s"), "end_page": F.col("e")}).select(*nodes.columns)


def normalize(nodes: DataFrame, passes: int = 1) -> DataFrame:
    """Clean, dedupe, recompute. Two passes are the fixpoint: pages that become equal in the first make duplicates for the second."""
    for _ in range(passes):
        nodes = recompute_spans(dedupe_siblings(clean_sections(nodes)))
    return nodes


def leaves(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a boolean ``leaf``: the next node in preorder isn't below."""
    nxt = F.lead("ord").over(Window.partitionBy("doc_id").orderBy("ord"))
    return nodes.withColumn("leaf", F.coalesce(F.slice(nxt, F.lit(1), F.size("ord")) != F.col("ord"), F.lit(True)))


def summarize(nodes: DataFrame) -> DataFrame:
    """(doc_id, total, leaves, max_depth, top_level), the root not counted."""
    n = leaves(nodes.filter(F.size("ord") > 0))
    return n.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("leaf").alias("leaves"), F.max(F.size("ord")).cast("long").alias("max_depth"), F.count_if(F.size("ord") == 1).alias("top_level"))


def with_path(nodes: DataFrame, column: str = "title", name: str = "path") -> DataFrame:
    """``nodes`` with the ancestors' and own ``column`` in order."""
    rows = _spread(with_ancestors(nodes.repartition("doc_id"), root=True), "label_", F.col(column))
    listed = F.array_sort(F.collect_list(F.when(F.col("label_").isNotNull(), F.struct(F.size("anc").alias("k"), F.col("label_").alias("x")))).over(Window.partitionBy("doc_id", "ord")))
    return rows.withColumn(name, F.transform(listed, lambda r: r["x"])).filter(F.col("ord") == F.col("anc")).drop("label_", "anc")


def paths(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, path) with labels 'number title' joined by ' > '; a section without title takes its subtree with it."""
    n = nodes.filter(F.size("ord") > 0).withColumns({"title": T.clean_text("title"), "number": T.clean_text("number")})
    n = drop_flagged(n, F.col("title") == "").withColumn("label", F.trim(F.concat_ws(" ", "number", "title")))
    return with_path(n, "label").select("doc_id", "ord", F.array_join("path", " > ").alias("path"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, path, change): distinct paths that only one side has, 'removed' or 'added'."""
    a, b = (paths(x).select("doc_id", "path").distinct() for x in (before, after))
    return a.subtract(b).withColumn("change", F.lit("removed")).unionByName(b.subtract(a).withColumn("change", F.lit("added")))


def diff_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, n_before, n_after, delta): sections with a title; below an untitled one they still count."""
    count = lambda x, name: x.filter((F.size("ord") > 0) & (T.clean_text("title") != "")).groupBy("doc_id").agg(F.count("*").alias(name))
    z = lambda c: F.coalesce(c, F.lit(0))
    both = count(before, "n_before").join(count(after, "n_after"), "doc_id", "full")
    return both.select("doc_id", z("n_before").alias("n_before"), z("n_after").alias("n_after"), (z("n_after") - z("n_before")).alias("delta"))


# Flat lists with levels: (doc_id, i, level, start_page, total_pages) ------------------------------


def nearest(rows: DataFrame, level: str, value: str, name: str, *, later: bool = False) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the nearest earlier row of a document with a smaller ``level``, or with ``later`` of the nearest later one with a level that isn't larger.

    One pass over a document's rows in the order of i, with a stack of the levels that are still open, so the
    work is linear. Rows without a level get null and stop no others.
    """
    kept = [c for c in rows.columns if c != name]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = walk  # no doc_id
        open_: list[tuple] = []
        for batch in batches:
            out = []
            for d, x, v in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", level, value)), strict=True):
                if d != doc:
                    doc, open_ = d, []
                if x is None:
                    out.append(None)
                    continue
                while open_ and (open_[-1][0] > x or open_[-1][0] == x and not later):
                    open_.pop()
                out.append(open_[-1][1] if open_ else None)
                open_.append((x, v))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(out, batch.schema.field(value).type)], [*kept, name])

    order = F.col("i").desc() if later else F.col("i").asc()
    kind = StructType([*(rows.schema[c] for c in kept), StructField(name, rows.schema[value].dataType)])
    return rows.select(*kept).repartition("doc_id").sortWithinPartitions("doc_id", order).mapInArrow(walk, kind)


def nest_by_level(rows: DataFrame) -> DataFrame:
    """``rows`` with ``parent``: the nearest earlier row of a smaller level."""
    return nearest(rows, "level", "i", "parent")


def end_page_by_level(rows: DataFrame) -> DataFrame:
    """``rows`` with ``end_page``: a page before the next row that isn't deeper, at least the start; else the last page."""
    end = F.greatest(F.col("start_page"), F.coalesce(F.col("then") - 1, F.col("total_pages")))
    return nearest(rows, "level", "start_page", "then", later=True).withColumn("end_page", F.when(F.col("then").isNotNull(), end).otherwise(F.col("total_pages"))).drop("then")


def ords_from_parents(rows: DataFrame) -> DataFrame:
    """(doc_id, i, ord) from parent pointers (null for the top), siblings in the order of i; parents come before their children."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = walk  # no doc_id
        for batch in batches:
            out = []
            for d, i, up in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d != doc:
                    doc, count, ords = d, {}, {None: []}
                count[up] = count.get(up, 0) + 1
                ords[i] = [*ords.get(up, []), count[up]]
                out.append(ords[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "i", "ord"])

    ordered = rows.select("doc_id", F.col("i").cast("long").alias("i"), F.col("parent").cast("long").alias("parent")).repartition("doc_id").sortWithinPartitions("doc_id", "i")
    return ordered.mapInArrow(walk, f"doc_id {kind}, i long, ord array<int>")


def hierarchical_outline(entries: DataFrame) -> DataFrame:
    """Nested sections of TOC entries (doc_id, i, level, title, number, start_page, total_pages): ord, slug and end pages."""
    nested = end_page_by_level(nest_by_level(entries))
    return nested.join(ords_from_parents(nested), ["doc_id", "i"]).select("doc_id", "ord", T.slugify("title").alias("slug"), "title", "number", F.lit("heading").alias("role"), "start_page", "end_page")


def end_pages_preorder(nodes: DataFrame, total_pages: F.Column | None = None) -> DataFrame:
    """End page of each node: a page before the next known start in preorder (at least its own start); else the last page."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    total = F.lit(None).cast("int") if total_pages is None else total_pages
    then = F.first("start_page", ignorenulls=True).over(w)
    end = F.when(F.col("start_page").isNull(), None).otherwise(F.greatest("start_page", F.coalesce(then - 1, total, F.col("start_page"))))
    return nodes.withColumn("end_page", end)


def parent_ends(nodes: DataFrame) -> DataFrame:
    """A parent's end page becomes the greatest of its children's final ends, where any child has one.

    Closed form: the greatest own end among the node and its descendants that have an own end but no
    strict descendant with one.
    """
    has = nodes.filter("end_page IS NOT NULL").select("doc_id", "ord", "end_page")
    above = with_ancestors(has.select("doc_id", "ord"), own=False).select(F.col("doc_id").alias("ad"), F.col("anc").alias("ao")).distinct()
    lowest = has.join(above, (F.col("doc_id") == F.col("ad")) & (F.col("ord") == F.col("ao")), "left_anti")
    final = with_ancestors(lowest).groupBy("doc_id", "anc").agg(F.max("end_page").alias("final"))
    return nodes.join(final.withColumnRenamed("anc", "ord"), ["doc_id", "ord"], "left").withColumn("end_page", F.col("final")).drop("final").select(*nodes.columns)
