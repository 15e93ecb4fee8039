"""The training-data pipeline over `documents`: each stage works on what the one before kept.

Every stage takes an empty table, null ids, repeated rows and further columns, also such as
are called like the columns that a stage adds; what it does with null and empty texts is
said with it. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerlake.llm import decontaminate, langid, near_dup, sentencepieces, shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; others go, and so do null texts and texts without a letter."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id (null last); null texts are no copies of each other."""
    return near_dup.kept_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them; a null text is empty."""
    return sentencepieces.encoded(docs.select("doc_id", "text"), sentencepieces.public_model()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", sentencepiece)]

#: Three of the stages cannot be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.written(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            shared.remove(spark, f"{folder}/{k - 1}")
    return docs
