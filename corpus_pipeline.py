"""From raw documents to packed training sequences, in five stages.

Each stage gets the documents that the one before has kept, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefeed.llm.minhash import one_of_each
from tablefeed.llm.mixing import take_copies
from tablefeed.llm.packing import pack_documents
from tablefeed.llm.quality import kept_documents
from tablefeed.llm.secrets import without_secrets
from tablefeed.sources.tables import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the scorer rejects; those without words are among them."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the number of characters set anew where text is."""
    masked = docs.withColumn("text", without_secrets(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return take_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; copies are packed apart."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

# Learning, hashing and tokenizing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
