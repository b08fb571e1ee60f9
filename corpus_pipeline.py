"""The corpus pipeline: documents through quality rules, line dedup, SimHash near-dedup and
benchmark decontamination into packed pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; written as Parquet, it
is the next one's ``docs``.  All but the last keep the columns of ``documents``; where a
stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from faultline.llm.common import table
from faultline.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that fail the base rules or lose too much text go."""
    return quality_rules.quality_filter(docs, length_col="n_chars")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of fuzzy lines one line stays; documents without a line left go."""
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal fingerprints the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with a digest of their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids", "queue")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokens and XXH64 fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
