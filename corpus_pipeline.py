"""The corpus pipeline: documents through five operators of voxloom.llm, each stage's rows written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontam, jaccard, packing, secret_scan, toxicity
from voxloom.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored as toxic."""
    model = toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))
    return model.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five words, similarity 0.8): the first in the order of the stage's input.

    Rows are compared by a number of their own, so a row stays unless another of its component does, whatever doc_ids
    repeat or are null; of rows that repeat in all columns one stays. Texts without words (null, empty) are like no other.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard.ngram_jaccard_join(spark, numbered.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80, links=False)
    others = written(spark, found.where("component_id <> doc_id").select(F.col("doc_id").alias(row)), "others")
    return numbered.join(others, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a benchmark item."""
    return decontam.remove_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact_secrets(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.best_fit_packing(spark, docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secrets), ("packing", pack)]

#: The classifier, the components and the packing are iterative; SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
