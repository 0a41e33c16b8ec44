"""A corpus pipeline: quality, exact and near duplicates, benchmark leaks, packing.

Each stage takes what its predecessor kept, as Parquet, and but for the last returns the columns of
documents. Near duplicates are documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.8. SQL cannot express the classifier or the tokenizer, so ORACLE_SQL is None; tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontaminate, exact_dedup, exchange, ngram_join, packing, quality
from folioscan.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good and not toxic."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.kept_documents(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, linked directly or over others, the document with the smallest id."""
    return ngram_join.representatives(docs, n=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of eight words with any benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of tokens."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [("quality_classifier", quality_classifier), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = exchange.written(docs, name)
    return docs
