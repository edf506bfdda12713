"""The corpus pipeline: each stage is one of the operators, applied to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import op1, op3, op7, op9, op10
from pagelens.llm.shared import fold, store, table

#: Quality below which a document goes.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below ``LEAST_QUALITY``."""
    model = op7.learn(docs, table(spark, sf_dir, "labels"))
    return op7.keep_good(docs, model, LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that was learned."""
    learnt = op10.learn(docs.where(fold(F.col("doc_id"), op10.FOLDS) != 0))
    return op10.keep_identified(docs, learnt)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return op1.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op3.drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences."""
    return op9.pack(docs).drop("ids")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Four of the five stages can't be said in SQL; tests hold run() against its operators, stage
#: by stage, and those against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
