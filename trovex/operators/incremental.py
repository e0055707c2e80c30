"""What changed between two listings, and an index that parses only that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame, path: str = "path", hash: str = "file_hash") -> DataFrame:
    """(path, status) of every path of either listing: unchanged, added, modified or deleted. Null hashes equal each other."""
    both = old.select(F.col(path), F.col(hash).alias("_old"), F.lit(True).alias("_was")).join(new.select(F.col(path), F.col(hash).alias("_new"), F.lit(True).alias("_is")), path, "full_outer")
    status = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return both.select(path, status.alias("status"))


def refreshed(symbols: DataFrame, old_files: DataFrame, new_files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Symbols of the new listing: those of unchanged files as they were, the others extracted from new_files(path, file_hash, content, ...)."""
    diff = manifest_diff(old_files, new_files)
    kept = symbols.join(diff.where("status = 'unchanged'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    fresh = new_files.join(diff.where("status in ('added', 'modified')").select("path"), "path", "left_semi")
    return kept.select(*symbols.columns).unionByName(extract(fresh).select(*symbols.columns))


def index_stats(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row (symbol_count, file_count, total_bytes) over all files, parsed anew or not."""
    return symbols.agg(F.count(F.lit(1)).alias("symbol_count")).crossJoin(files.agg(F.count_distinct("path").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")))
