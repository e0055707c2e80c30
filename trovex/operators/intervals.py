"""Rows within other rows' ranges, and the last row before another, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enclosing(inner: DataFrame, outer: DataFrame, on: str, inner_range: tuple[Column, Column], outer_range: tuple[Column, Column], keys: list[str], value: str, name: str) -> DataFrame:
    """inner with a column name: value of the outer row of the same key that encloses it and starts last (ties: least value), else null.

    An equi-join on the key with a range condition; the aggregate runs before the wide columns come back.
    """
    a, b = inner_range
    c, d = outer_range
    start = F.unix_micros(F.col("_c").cast("timestamp")) if outer.select(c.alias("c")).dtypes[0][1].startswith("timestamp") else F.col("_c").cast("long")
    left = inner.select(on, *keys, a.alias("_a"), b.alias("_b"))
    right = outer.select(F.col(on).alias("_on"), c.alias("_c"), d.alias("_d"), F.col(value).alias("_v"))
    found = left.join(right, (F.col(on) == F.col("_on")) & (F.col("_c") <= F.col("_a")) & (F.col("_d") >= F.col("_b")))
    best = found.groupBy(on, *keys).agg(F.min_by("_v", F.struct(-start, F.col("_v"))).alias(name))
    return inner.join(best, [on, *keys], "left")


def nearest_preceding(rows: DataFrame, by: str, order: list[Column], value: Column, when: Column, name: str) -> DataFrame:
    """rows with a column name: value of the last row strictly before it in its group for which when holds; one window, no join."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(before))


def assign_parents(symbols: DataFrame) -> DataFrame:
    """symbols where methods, properties and fields without a parent get the innermost class around them in their file as one. Kinds stay as they are."""
    orphans = symbols.where(F.col("kind").isin("Method", "Property", "Field") & F.col("parent_id").isNull())
    classes = symbols.where("kind = 'Class'")
    keys = ["file_path", "id", "start_line", "end_line"]
    found = enclosing(orphans.select("repo_key", *keys).distinct().withColumn("_f", F.concat_ws("\x00", "repo_key", "file_path")), classes.withColumn("_f", F.concat_ws("\x00", "repo_key", "file_path")), "_f", (F.col("start_line"), F.col("end_line")), (F.col("start_line"), F.col("end_line")), ["repo_key", *keys], "id", "_parent")
    found = found.where("_parent is not null").select("repo_key", *keys, "_parent")
    return symbols.join(found, ["repo_key", *keys], "left").withColumn("parent_id", F.coalesce("parent_id", F.when(F.col("kind").isin("Method", "Property", "Field"), F.col("_parent")))).select(*symbols.columns)
