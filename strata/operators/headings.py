"""Headings and their hierarchy from layout items.

Items are (doc_id, collection, idx, self_ref, parent_ref, text, label, level, name, content_layer, page_no).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.functions import text as T
from strata.operators.outline import end_pages_preorder, ords_from_parents, parent_ends
from strata.staging import staged

def reference_index(items: DataFrame) -> DataFrame:
    """(doc_id, ref, up, label, name): the last item of each reference over the four collections, body and furniture."""
    order = F.when(F.col("collection") == "texts", 0).when(F.col("collection") == "groups", 1).when(F.col("collection") == "tables", 2).when(F.col("collection") == "pictures", 3).otherwise(4)
    last = items.filter("self_ref IS NOT NULL").groupBy("doc_id", F.col("self_ref").alias("ref")).agg(F.max_by(F.struct(F.col("parent_ref").alias("up"), "label", "name"), F.struct(order.alias("o"), "idx")).alias("x"))
    return last.select("doc_id", "ref", "x.*")


def ancestors(items: DataFrame) -> DataFrame:
    """(doc_id, self_ref, ref): all references on the way from each text to the root, a dangling last one included.

    What each container reaches is found by doubling: steps of one, two, four and so on, until nothing is
    new, so a chain of any length takes as many rounds as its logarithm, and a cycle ends where it closes.
    """
    start = items.filter("collection = 'texts' AND parent_ref IS NOT NULL").select("doc_id", "self_ref", F.col("parent_ref").alias("ref")).distinct()
    up = reference_index(items).filter("up IS NOT NULL").select("doc_id", "ref", "up")
    parents = items.filter("parent_ref IS NOT NULL").select(F.col("doc_id").alias("pd"), F.col("parent_ref").alias("pr")).distinct()
    reach = staged(up.join(parents, (F.col("doc_id") == F.col("pd")) & (F.col("ref") == F.col("pr")), "left_semi"), "reach")
    known, n = 0, reach.count()
    while n > known:
        a, b = reach.alias("a"), reach.alias("b")
        further = a.join(b, F.expr("a.doc_id = b.doc_id AND a.up = b.ref")).select("a.doc_id", "a.ref", F.col("b.up").alias("up"))
        reach = staged(reach.unionByName(further).distinct(), "reach")
        known, n = n, reach.count()
    s, r = start.alias("s"), reach.alias("r")
    above = s.join(r, F.expr("s.doc_id = r.doc_id AND s.ref = r.ref")).select("s.doc_id", "s.self_ref", F.col("r.up").alias("ref"))
    return start.unionByName(above).distinct()


def local_areas(items: DataFrame) -> DataFrame:
    """(doc_id, self_ref) of texts inside tables, pictures, forms or rich cells."""
    a = ancestors(items).alias("a").join(reference_index(items).alias("i"), F.expr("a.doc_id = i.doc_id AND a.ref = i.ref"), "left")
    local = F.col("a.ref").startswith("#/tables/") | F.col("a.ref").startswith("#/pictures/") | F.coalesce(F.col("i.label").isin("key_value_area", "form_area"), F.lit(False)) | F.coalesce(F.col("i.name").startswith("rich_cell_group"), F.lit(False))
    return a.filter(local).select("a.doc_id", "a.self_ref").distinct()


def forward_pages(texts: DataFrame) -> DataFrame:
    """``texts`` without marker rows, with ``page``: the item's own page, else that of the last marker before it."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = texts.withColumn("marker", T.detect_page_marker("text"))
    marked = marked.withColumn("carried", F.last("marker", ignorenulls=True).over(w))
    return marked.filter("marker IS NULL").withColumn("page", F.coalesce("page_no", "carried")).drop("marker", "carried")


def candidates(items: DataFrame, exclude_table_like_areas: bool = True) -> DataFrame:
    """Texts that may be headings: explicit ones, or labelled section_header or title; cheap filters come before the anti join."""
    t = items.filter("collection = 'texts'")
    clean = T.clean_text("text")
    t = t.filter((clean != "") & ~T.is_image_placeholder(clean) & ~T.is_page_number_noise(clean) & ~T.is_repeated_footer(clean) & (F.coalesce("content_layer", F.lit("")) != "furniture"))
    explicit = F.coalesce(T.heading_info(clean)["kind"] == "heading", F.lit(False))
    t = t.filter(explicit | F.coalesce(F.col("label").isin("section_header", "title"), F.lit(False)))
    if exclude_table_like_areas:
        a = local_areas(items).select(F.col("doc_id").alias("ld"), F.col("self_ref").alias("lr"))
        t = t.join(a, (F.col("doc_id") == F.col("ld")) & (F.col("self_ref") == F.col("lr")), "left_anti")
    return t


def unique_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, idx, id): the first free of base, base-2, base-3, ... in a document's order. Sequential within a document."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        used: set[str] = set()
        following: dict[str, int] = {}  # the first number of a base that hasn't been tried
        out = []
        for base in pdf["base"]:
            name = base
            while name in used:
                k = following.get(base, 2)
                name, following[base] = f"{base}-{k}", k + 1
            used.add(name)
            out.append(name)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "idx": pdf["idx"], "id": out})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), "base").groupBy("doc_id").applyInPandas(pick, f"doc_id {kind}, idx long, id string")


def flat_headings(items: DataFrame, exclude_table_like_areas: bool = True) -> DataFrame:
    """(doc_id, i, idx, id, number, title, role, page, depth, numbering_type, roman_index): headings in order, i from 0."""
    texts = items.filter("collection = 'texts'")
    pages = forward_pages(texts).select(F.col("doc_id").alias("pd"), F.col("idx").alias("pi"), "page")
    c = candidates(items, exclude_table_like_areas).join(pages, (F.col("doc_id") == F.col("pd")) & (F.col("idx") == F.col("pi")))
    clean = T.clean_text("text")
    c = c.withColumn("h", T.heading_info(clean))
    explicit = F.coalesce(F.col("h.kind") == "heading", F.lit(False))
    c = c.select("doc_id", "idx", F.col("h.number").alias("number"), F.when(explicit, F.col("h.title")).otherwise(clean).alias("title"), F.when(explicit, F.col("h.clean_title")).otherwise(clean).alias("clean_title"), "page", F.when(explicit, F.col("h.depth")).otherwise(F.coalesce("level", F.lit(1))).alias("depth"), F.col("h.numbering_type").alias("numbering_type"), F.col("h.roman_index").alias("roman_index"))
    c = c.filter((F.col("title") != "") & ~T.is_generic_toc_heading("clean_title", "number"))
    c = c.withColumn("base", T.slugify("title", F.concat(F.lit("section-"), F.col("idx").cast("string"))))
    ids = unique_ids(c).select(F.col("doc_id").alias("ud"), F.col("idx").alias("ui"), "id")
    role = F.when(F.col("numbering_type") == "bullet", "bullet_heading").otherwise("heading")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1
    return c.join(ids, (F.col("doc_id") == F.col("ud")) & (F.col("idx") == F.col("ui"))).select("doc_id", place.alias("i"), "idx", "id", "number", "title", role.alias("role"), "page", "depth", "numbering_type", "roman_index")


def drop_isolated_unnumbered(flat: DataFrame) -> DataFrame:
    """Without plain headings between the first and the last numbered one of a document; bullets stay."""
    w = Window.partitionBy("doc_id")
    numbered = F.coalesce(F.col("numbering_type").isin("decimal", "roman"), F.lit(False))
    lo, hi = F.min(F.when(numbered, F.col("i"))).over(w), F.max(F.when(numbered, F.col("i"))).over(w)
    f = flat.withColumn("inside", F.coalesce(F.col("i").between(lo, hi), F.lit(False)))
    return f.filter(F.col("numbering_type").isNotNull() | ~F.col("inside")).drop("inside")


def heading_parents(flat: DataFrame) -> DataFrame:
    """``flat`` with ``parent`` (the i of the parent, null at the top).

    Roman headings are roots. A decimal one hangs under the latest earlier decimal with its number less
    the last part, else under the latest earlier roman one of its first part's value. A bullet hangs
    under the latest earlier heading that is no bullet. A plain one hangs under the nearest earlier
    non-bullet of smaller depth, not beyond the last numbered heading. One pass in a document's order,
    with the latest heading of each number and a stack of depths.
    """
    part = F.try_element_at(F.split("number", r"\."), F.lit(1)).try_cast("int")
    rows = flat.drop("parent").withColumns({"up_": T.parent_decimal_number("number"), "part_": part})
    columns = [c for c in rows.columns if c not in ("up_", "part_")]
    place = flat.schema["i"].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = walk  # no doc_id
        for batch in batches:
            out = []
            names = ("doc_id", "i", "numbering_type", "number", "roman_index", "depth", "up_", "part_")
            for d, i, kind, number, roman, depth, up, first in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if d != doc:
                    doc, decimal, romans, open_, numbered, structural = d, {}, {}, [], -1, None
                parent = None
                if kind == "decimal":
                    parent = decimal.get(up)
                    parent = romans.get(first) if parent is None else parent
                elif kind == "bullet":
                    parent = structural
                if kind != "bullet":
                    structural = i
                    if depth is not None:
                        while open_ and open_[-1][0] >= depth:
                            open_.pop()
                        if kind is None and open_ and open_[-1][1] >= numbered:
                            parent = open_[-1][1]
                        open_.append((depth, i))
                if kind in ("decimal", "roman"):
                    numbered = i
                if kind == "decimal" and number is not None:
                    decimal[number] = i
                if kind == "roman" and roman is not None:
                    romans[roman] = i
                out.append(parent)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(out, batch.schema.field("i").type)], [*columns, "parent"])

    kind = StructType([*(flat.schema[c] for c in columns), StructField("parent", place)])
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "i").mapInArrow(walk, kind)


def headings_outline(items: DataFrame, total_pages: int | None = None, exclude_table_like_areas: bool = True, keep_isolated_unnumbered: bool = False) -> DataFrame:
    """Outline rows (doc_id, ord, id, title, number, role, start_page, end_page) from layout items."""
    flat = flat_headings(items, exclude_table_like_areas)
    if not keep_isolated_unnumbered:
        flat = drop_isolated_unnumbered(flat)
    h = staged(heading_parents(flat), "headings")  # feeds two branches
    o = h.join(ords_from_parents(h), ["doc_id", "i"]).select("doc_id", "ord", "id", "title", "number", "role", F.col("page").alias("start_page"), F.col("page").alias("end_page"))
    return parent_ends(staged(end_pages_preorder(o, None if total_pages is None else F.lit(total_pages)), "end-pages"))


def adapter_outlines(documents: DataFrame, items: DataFrame, override: str | None = None, total_pages: int | None = None, exclude_table_like_areas: bool = True, keep_isolated_unnumbered: bool = False) -> DataFrame:
    """Whole outlines: the sections of headings_outline() under a root with the title of each document, found or not."""
    sections = headings_outline(items, total_pages, exclude_table_like_areas, keep_isolated_unnumbered)
    none = lambda c: F.lit(None).cast(sections.schema[c].dataType).alias(c)
    titles = document_title(documents, override)
    root = titles.select("doc_id", F.array().cast("array<int>").alias("ord"), none("id"), "title", *[none(c) for c in ("number", "role", "start_page", "end_page")])
    return root.unionByName(sections.join(titles.select(F.col("doc_id").alias("td")), F.col("doc_id") == F.col("td"), "left_semi"))


def document_title(documents: DataFrame, override: str | None = None) -> DataFrame:
    """(doc_id, title) of (doc_id, name, filename, stem): the override, else the first that isn't empty."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    return documents.select("doc_id", F.coalesce(F.nullif(F.lit(override), F.lit("")), full("name"), full("filename"), full("stem")).alias("title"))
