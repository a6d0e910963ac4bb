"""A training corpus from raw documents: quality, near copies, repeated passages, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oncolens.llm import best_fit, block_anchors, poisson_mixing, rule_quality, simhash
from oncolens.llm.common import pick, ship, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents; a table with more columns loses them, whatever their names."""
    ship(docs.sparkSession)
    return pick(docs, **{c: c for c in COLUMNS})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more; the ensemble is learnt from this stage's own input.

    Where the labels teach no rule, one score for all says nothing of a document and all stay.
    """
    docs = documents(docs)
    model = rule_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.rules:
        return docs
    return rule_quality.scored(docs, model, into="quality_score").where("quality_score >= 0.3").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return simhash.keep_one(documents(docs), shingle=4, radius=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages an earlier one has; untouched texts stay as they are.

    A cut text is its kept words joined by spaces, n_chars its new length. Documents of
    which nothing is left go.
    """
    found = block_anchors.remove_repeats(
        documents(docs), keep=("lang", "source", "n_chars"), window=13, untouched=True
    )
    return found.where("n_removed = 0 OR n_removed < n_words").select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "lang",
        "source",
        F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it, shuffled; copies repeat the whole row."""
    return poisson_mixing.replicate(documents(docs)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies, with their token ids, in sequences of at most 1024 tokens."""
    return best_fit.pack(documents(docs), capacity=1024, end_id=2, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The quality classifier is learnt, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
