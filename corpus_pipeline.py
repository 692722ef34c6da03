"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as Parquet in
the shared folder and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from ledgerloom.llm.common import settle, table, unsettle
from ledgerloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that stands out go."""
    return language_id.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least id stays. Documents link by shingles of five words, at 0.8."""
    return jaccard_join.first_of_each(docs, shingle=5, similar=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontaminate", benchmark_passages), ("secret_scan", secrets), ("packing", pack)]

#: A trained network and a tokenizer are beyond SQL; tests/llm holds each stage against a brute-force version, but for the
#: languages, which it takes from the operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        unsettle(before)
    return docs
