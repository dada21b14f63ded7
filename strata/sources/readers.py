"""Materialised inputs: JSON documents, layout items, manifests. All reads go through Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json): one row a file. doc_id is the file's path below ``path`` (below its last folder without wildcards) without extension.

    So files of one name in the folders of several documents stay apart.
    """
    root = re.split(r"[*?\[{]", path)[0]
    root = root[: root.rfind("/") + 1] if len(root) < len(path) else root.rstrip("/") + "/"
    root = re.sub(r"^\w+:/+", "/", root)
    name = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"\.[^./]*$", "")
    below = F.when(F.contains(name, F.lit(root)), F.element_at(F.split(name, re.escape(root), 2), 2)).otherwise(F.element_at(F.split(name, "/"), -1))
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    return rows.select(below.alias("doc_id"), "json")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a multi-line JSON file or folder with a fixed schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, gold, pred) of the pairs to report on."""
    return json_records(spark, path, "name string, gold string, pred string")


def graphs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph JSON (doc_id, json), in list order; pages that aren't integers are null."""
    schema = (
        "nodes array<struct<id:string,label:string,kind:string,title:string,number:string,role:string,page_start:int,page_end:int,evidence_pages:array<int>,path:array<string>>>,"
        "edges array<struct<source:string,target:string,type:string>>"
    )
    g = docs.select(F.col("doc_id").alias("graph_id"), F.from_json("json", schema).alias("g"))
    part = lambda name: g.select("graph_id", F.posexplode(f"g.{name}").alias("pos", "x")).select("graph_id", F.col("pos").cast("long").alias("pos"), "x.*")
    return part("nodes"), part("edges")


def layout_items(docs: DataFrame) -> DataFrame:
    """Layout items of document JSON (doc_id, json): four collections, body and furniture."""
    kind = "array<struct<self_ref:string,parent:struct<`$ref`:string>,text:string,label:string,level:int,name:string,content_layer:string,prov:array<struct<page_no:int>>>>"
    single = "struct<self_ref:string,parent:struct<`$ref`:string>,text:string,label:string,level:int,name:string,content_layer:string,prov:array<struct<page_no:int>>>"
    schema = ",".join(f"{n} {kind}" for n in ("texts", "groups", "tables", "pictures")) + "," + ",".join(f"{n} {single}" for n in ("body", "furniture"))
    d = docs.select("doc_id", F.from_json("json", schema).alias("d"))
    out = None
    for name in ("texts", "groups", "tables", "pictures", "body", "furniture"):
        if name in ("body", "furniture"):
            rows = d.filter(F.col(f"d.{name}").isNotNull()).select("doc_id", F.lit(0).alias("idx"), F.col(f"d.{name}").alias("x"), F.lit(f"#/{name}").alias("ref"))
        else:
            rows = d.select("doc_id", F.posexplode(f"d.{name}").alias("idx", "x")).select("doc_id", "idx", "x", F.col("x.self_ref").alias("ref"))
        rows = rows.select("doc_id", F.lit(name).alias("collection"), F.col("idx").cast("long").alias("idx"), F.col("ref").alias("self_ref"), F.col("x.parent")["$ref"].alias("parent_ref"), "x.text", "x.label", "x.level", "x.name", "x.content_layer", F.try_element_at("x.prov", F.lit(1))["page_no"].alias("page_no"))
        out = rows if out is None else out.unionByName(rows)
    return out


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``; made and written first where it doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
