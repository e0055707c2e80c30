"""The queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm import bpe, exact_dedup, licenses, mixing, near_dedup, phrases, quality, sharding, sstable, warc
from trovex.llm.shared import workers_find_us


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.sorted_shards(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id) of every document that goes, with the one of its group that stays."""
    groups = near_dedup.near_groups(_table(spark, sf_dir, "documents"))
    return groups.where("not stays").selectExpr("id as doc_id", "keep_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, taken from the archive's two tables."""
    records = warc.records(*warc.archive(_table(spark, sf_dir, "pages")))
    return records.select(F.col("id").alias("page_id"), "digest", F.decode("record", "UTF-8").alias("record"))  # pages are text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sstable, op2_licenses, op3_bpe, op4_exact_dedup, op5_phrases, op6_near_dedup, op7_mixing, op8_quality, op9_sharding, op10_warc)}
SQL: dict[str, str] = {"op2_licenses": licenses.sql(), "op4_exact_dedup": exact_dedup.SQL, "op7_mixing": mixing.sql(), "op10_warc": warc.SQL}
