"""A training-data pipeline of five stages over the operators of ``tabguard.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last keep the
columns of documents, whatever their names.

In all stages an empty table gives an empty table, repeated rows are treated
alike, texts of any length are read whole, and columns other than doc_id, text,
source and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabguard.llm import decontam, mixing, neardup, quality, secrets
from tabguard.llm.shared import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps; null, empty and blank texts go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id, null last; null and empty texts are one class."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and n_chars to match; null texts stay null."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with ``copy`` from 1; null sources are one source, texts without words are not taken."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Signatures and a network have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
