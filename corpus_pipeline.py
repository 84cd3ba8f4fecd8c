"""The corpus pipeline: STAGES over documents, each one an operator of graphloom.llm.

Every stage takes (spark, docs, sf_dir); docs is what its predecessor kept. Rows are identified by
doc_id and text, so nulls and repeated rows pass through as the operators define them. Columns of any
name stay as they are; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, language_id, packing, pii, suffix_dedup
from graphloom.storage import drop_written, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return jaccard_join.keep_one(docs, size=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere leave the texts."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised or removed."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL cannot express language ID, sanitisation or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), release=True)
        # What this stage read is read no more.
        drop_written(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
