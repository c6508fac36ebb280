"""A corpus pipeline over `documents`: each stage is one operator, reads what the stage before kept, and is written as Parquet.

Toxic documents go; lines that many documents share go; of each group of near duplicates the one with the smallest id
stays; personal data is replaced by its kind; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolith.llm.common import removed, shared_folder, tidied, written
from gyrolith.llm.line_dedup import drop_common_lines
from gyrolith.llm.near_dup import near_duplicates
from gyrolith.llm.packing import pack_documents
from gyrolith.llm.pii import find_pii
from gyrolith.llm.toxicity import fit, score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text) -> DataFrame:
    """The documents' columns with a new text and its length."""
    found = docs.withColumn("text", text)
    return found.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the models, learned from `labels`, don't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.select("doc_id", "text"), labels)
    return score_documents(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that at least 10 of them share."""
    return with_text(drop_common_lines(docs), F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, and of repeated rows one."""
    found = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = docs.join(written(found, f"{shared_folder(spark)}/kept"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*COLUMNS).unionAll(docs.where("doc_id IS NULL").select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data replaced."""
    found = find_pii(docs.select(*COLUMNS), redact="text")
    return with_text(found, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: The first stage is a model and the third a graph, which SQL cannot state; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    folder, docs, before = shared_folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        with tidied():  # the stage's own tables go when its rows are written
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
