"""Corpus pipeline: each stage's table is written as Parquet and read again as the next one's input.

Documents that the quality rules reject go first, then exact copies, then near copies but for one of each group; what is
left is packed into sequences.  A stage reads all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm import best_fit, exact_dedup, near_copies, quality_rules
from cardloom.llm.scratch import stage

#: Bytes of each of the encoder's two tables in a worker: the executors still hold what earlier stages have left.
KNOWN = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id."""
    return near_copies.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their places in sequences of 2048 tokens."""
    return best_fit.pack_documents(docs, known=KNOWN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("packing", packing)]

#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
