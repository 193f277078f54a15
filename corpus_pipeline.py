"""From raw documents to packed training sequences: five stages, each an operator of corvane.llm on all that the last one kept.

Every stage takes nulls in any column, empty and very long texts (read whole), repeated rows, empty tables and further
columns of any names: toxicity judges rows by their texts and keeps null and empty ones; near_dedup keeps rows that have no
words, and one row of a repeated doc_id; decontamination keeps documents without words; secrets changes texts only;
packing gives no row but the end mark's for a null or empty text. Ties are settled in the operators' docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import shared_dir, written
from corvane.llm.decontaminate import without_contaminated
from corvane.llm.minhash import deduplicated
from corvane.llm.packing import pack_documents
from corvane.llm.secret_scan import redact_secrets
from corvane.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels, doesn't reject."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, and their places in sequences of 2048 ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
