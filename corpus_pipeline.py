"""A pipeline from documents to token ids: language, near duplicates, contamination, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns
the columns of its input; the last returns the token index. Null texts leave at the first stage; null
doc_ids are kept where nothing speaks against the text. Tables may be empty and may have more columns,
whatever their names. Texts of any length are read whole; empty ones leave at the first stage. Rows that
repeat a doc_id share their fate in the second and third stage, are mixed each, and are written each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, langid, minhash, mixing, token_file
from strata.llm._shared import discard, staged, table

#: Below this probability no language is believed; with four languages chance is 0.25.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too) or a recognised language go. Rows are judged each, repeated ones alike."""
    found = langid.predict_language(docs, keep=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays, with all its rows; a doc_id's texts are one document. Null ids stay."""
    gone = staged(minhash.near_duplicates(docs, n=5, num=80, den=100).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "duplicates")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or reparameterised, go, with all rows of their doc_id; null ids are one document."""
    gone = staged(decontam.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc").alias("gone")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one that a source takes in part counts if that is half or more. Ties go by size, then by a hash of the text; a document without words isn't taken."""
    mixed = mixing.mix_documents(docs, keep=docs.columns)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("times", times).filter("times > 0").select(F.explode(F.sequence(F.lit(1), F.col("times"))), "kept").select("kept.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's index, read back: a row for each row, by doc_id and text, null ids first."""
    return token_file.read(token_file.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL can express neither a trained network nor a tokenizer; tests/llm/test_pipeline.py has brute-force stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
