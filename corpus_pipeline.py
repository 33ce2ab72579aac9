"""From raw documents to token ids: quality rules, near duplicates, repeated text, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.

Defined results: no stage fails on nulls in any column, on empty or very long
texts, on repeated rows or on an empty table (which gives an empty one); all
columns that come in are kept, whatever their names, but for text in the last
stage. Each stage says what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, mixing, quality, simhash, substring_dedup
from tesserae.llm._spark import delete, shared_folder
from tesserae.llm.queries import BYTE_BPE, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others stay as they are. A null or empty text has no words and is rejected; repeated rows go or stay together."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints one stays, that of the smallest doc_id (null last); of repeated rows one stays. Texts without words are linked to each other."""
    return simhash.representatives(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows of an earlier document go from text; n_chars follows. A document of which nothing is left stays, empty. Rows that share a doc_id, and those without one, don't remove from each other; null and empty texts stay as they are."""
    return substring_dedup.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document as often as the mix takes it. Null and empty texts give no words and go; a null source is a source; rows that share doc_id and key are taken or left together."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document instead of its text, decoded again to compare. Null and empty texts have none; repeated rows are encoded each."""
    return bpe.encode(docs, BYTE_BPE)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated text", repeated_text), ("mixing", mix), ("encoding", encode)]

#: Suffix arrays, fingerprints and byte pairs aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote is deleted when the next one has been written; the last stage's input stays, as the result reads it."""
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
