"""Recognised pages and model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (doc_id, pos, index, ...) with ``page_number``: a document's indexes from 0 become from 1; a missing one is its place."""
    zero = F.min("index").over(Window.partitionBy("doc_id")) == 0
    return pages.withColumn("page_number", F.coalesce("index", F.col("pos") + 1) + F.when(zero, 1).otherwise(0))


def page_blob(pages: DataFrame) -> DataFrame:
    """(doc_id, blob): '# PAGE n' headers and page texts in order, stripped."""
    each = F.concat(F.lit("\n\n# PAGE "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("markdown", F.lit("")))
    g = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", each.alias("t")))).alias("p"))
    return g.select("doc_id", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), "\n"), F.lit(r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"), F.lit("")).alias("blob"))


def prompts(blobs: DataFrame, rules: str, outlines: DataFrame | None = None) -> DataFrame:
    """(doc_id, prompt): rules, the pages, and the outline JSON (doc_id, json) where one is given."""
    if outlines is None:
        return blobs.select("doc_id", F.concat(F.lit(rules), F.lit("\n\n"), "blob").alias("prompt"))
    return blobs.join(outlines, "doc_id").select("doc_id", F.concat(F.lit(rules), F.lit("\n\n"), "json", F.lit("\n\n"), "blob").alias("prompt"))


def response_text(responses: DataFrame) -> DataFrame:
    """(doc_id, text) of recorded responses (doc_id, json): output_text, else the message's content, a text or a list of parts joined by newlines."""
    whole = F.try_parse_json("json")
    content = F.try_variant_get(whole, "$.choices[0].message.content", "variant")
    listed = F.startswith(F.schema_of_variant(content), F.lit("ARRAY"))  # by type: a text may start with a bracket
    parts = F.array_join(F.transform(F.from_json(F.to_json(content), "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    said = F.when(listed, parts).otherwise(F.try_variant_get(content, "$", "string"))
    return responses.select("doc_id", F.coalesce(F.try_variant_get(whole, "$.output_text", "string"), said, F.lit("")).alias("text"))


def lenient_json(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with ``json``: the whole text if it parses, else from its first to its last brace, else null; ``parse_error`` says so."""
    t = F.trim(F.col(column))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return texts.withColumn("json", F.coalesce(ok(t), ok(F.nullif(inner, F.lit(""))))).withColumn("parse_error", F.col("json").isNull())


def token_usage(responses: DataFrame, provider: str) -> DataFrame:
    """(doc_id, input_tokens, output_tokens, total_tokens) of recorded usage (doc_id, json). With prompt/completion names a 0 falls through to the other name."""
    n = lambda p: F.get_json_object("json", p).cast("long")
    if provider == "mistral":
        pick = lambda a, b: F.coalesce(F.nullif(n(a), F.lit(0)), n(b))
        return responses.select("doc_id", pick("$.prompt_tokens", "$.input_tokens").alias("input_tokens"), pick("$.completion_tokens", "$.output_tokens").alias("output_tokens"), n("$.total_tokens").alias("total_tokens"))
    i, o = n("$.input_tokens"), n("$.output_tokens")
    return responses.select("doc_id", i.alias("input_tokens"), o.alias("output_tokens"), F.coalesce(n("$.total_tokens"), i + o).alias("total_tokens"))
