"""Corpus pipeline: quality rules, near-dedup, personal data, source mixing and piece encoding of the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and read
again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence.llm import mixing, near_dedup, personal_data, pieces, quality_rules
from evidence.operators.scale import stored
from evidence.plans.catalog import table
from evidence.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.where("kept").select("_row.*").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    ship_package(spark)
    return near_dedup.keep_one(docs.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    ship_package(spark)
    found = personal_data.find(docs.select(*COLUMNS), personal_data.train(docs))
    text = F.col("masked")
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), text.alias("text"), F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"),
        F.coalesce(F.length(text).cast("long"), F.col("_row.n_chars")).alias("n_chars"),
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh the square root of their size, in shuffled order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text."""
    ship_package(spark)
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [
    ("quality rules", quality),
    ("near-dedup", dedup),
    ("personal data", private),
    ("source mixing", mix),
    ("piece encoding", encode),
]

#: SQL cannot express signatures, the field or the search; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
