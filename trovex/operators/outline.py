"""Outlines: symbols in the order of lines with their place in the tree, and the files of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovex.shelf import Shelf


def outline(symbols: DataFrame, id: str = "id", parent: str = "parent_id", order: str = "start_line") -> DataFrame:
    """symbols with depth (roots 0), root_id, child_count and path (ids from the root). One whose parent isn't there is a root.

    Repeated identifiers count once, the first line wins. Chains may be of any length: every round doubles the reach of all
    rows, so depth d needs about log d joins. A chain that loops has no root and is left out.
    """
    shelf = Shelf(symbols.sparkSession)
    first = F.row_number().over(Window.partitionBy(id).orderBy(order))
    once = shelf.keep(symbols.withColumn("_n", first).where("_n = 1").drop("_n"))
    links = once.select(F.col(id).alias("_id"), F.col(parent).alias("_parent"))
    known = links.join(links.select(F.col("_id").alias("_parent")), "_parent", "left_semi")
    kids = known.groupBy(F.col("_parent").alias("_id")).agg(F.count(F.lit(1)).cast("int").alias("child_count"))
    roots = links.join(known.select("_id"), "_id", "left_anti")
    # _up: the row above those of path, null where path begins at a root.
    cur = roots.select("_id", F.lit(None).cast(links.schema["_id"].dataType).alias("_up"), F.array("_id").alias("path"))
    cur = shelf.keep(cur.union(known.select("_id", F.col("_parent").cast(links.schema["_id"].dataType), F.array("_id"))))
    waiting = cur.where("_up is not null").count()
    while waiting:
        above = cur.select(F.col("_id").alias("_at"), F.col("_up").alias("_next"), F.col("path").alias("_before"))
        higher = cur.where("_up is not null").join(above, F.col("_up") == F.col("_at")).select("_id", F.col("_next").alias("_up"), F.concat("_before", "path").alias("path"))
        nxt = shelf.keep(cur.where("_up is null").union(higher))
        left = nxt.where("_up is not null").count()
        shelf.drop(cur)
        cur = nxt
        if left == waiting:  # no row of the next depths: what is left loops
            break
        waiting = left
    tree = cur.where("_up is null").select(F.col("_id").alias(id), (F.size("path") - 1).alias("depth"), F.get("path", F.lit(0)).alias("root_id"), "path")
    return once.join(tree, id).join(kids.withColumnRenamed("_id", id), id, "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    return outline(symbols.where(F.col("file_path") == path)).orderBy("start_line", "id")


def file_tree(paths: DataFrame, prefix: str | None = None, path: str = "path") -> DataFrame:
    """Distinct paths with the prefix (case aside), in their order."""
    some = paths.where(F.startswith(F.lower(F.col(path)), F.lit(prefix.lower()))) if prefix else paths
    return some.select(path).distinct().orderBy(path)
