"""A corpus from documents to token ids: STAGES in order, each written as Parquet and read again as the next one's input.

All stages take texts of any length whole and give no rows for an empty table; all but the last return the columns of
docs as they were, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovex.llm import bpe, exact_dedup, mixing, near_dedup, quality
from trovex.llm.shared import Shelf, workers_find_us


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, fitted on the labels, doesn't reject. Null and empty texts go; without good or bad labels all others stay. Repeated rows are judged alike."""
    workers_find_us(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text: the smallest identifier, nulls last. Null texts all stay; empty ones equal each other."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Null and empty texts, and texts without a word, are in no group and stay."""
    workers_find_us(spark)
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, a row for each epoch. Null lang and source are nodes of their own; null and empty texts aren't drawn."""
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, repeated rows too."""
    workers_find_us(spark)
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: Training the ranker isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents in sf_dir; tables between stages are in the shared folder."""
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = shelf.keep(docs)
    return docs
