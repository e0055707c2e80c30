"""Helpers that every operator of this subpackage uses: names, key joins, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.shelf import Shelf, workers_find_us

__all__ = ["BROADCAST_KEYS", "Shelf", "col", "components", "fresh", "key_join", "numbers", "workers_find_us"]

#: Keys up to this number (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
#: Edges up to this number (16 bytes each) are joined to components on the driver, more by rounds of joins; the result is the same.
DRIVER_EDGES = 100_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """df's column by its exact name, dots and quotes included."""
    return df["`" + name.replace("`", "``") + "`"]


def numbers(spark: SparkSession, **columns: np.ndarray | list[int]) -> DataFrame:
    """A table of the driver's 64-bit integers. It goes to the JVM as Arrow: of a list of rows, Python workers with a daemon of their own would be started on the executors and stay."""
    return spark.createDataFrame(pa.table({name: pa.array(x, pa.int64()) for name, x in columns.items()}))


def key_join(big: DataFrame, keys: DataFrame, on: list[str], how: str, n: int | None = None) -> DataFrame:
    """Semi or anti join with a table of keys: broadcast if they are few by count, else by shuffle."""
    n = keys.count() if n is None else n
    return big.join(F.broadcast(keys) if n * len(on) <= BROADCAST_KEYS else keys.hint("merge"), on, how)


def _joined(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """components of a few edges, on the driver."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges.collect():  # DRIVER_EDGES rows at most
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    return shelf.keep(numbers(shelf.spark, node=nodes, label=[root(x) for x in nodes]))


def components(shelf: Shelf, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of each node of edges(a, b): label is the least node of its connected component.

    Alternating large-star and small-star rounds; every round is a table in the shared folder. A node's neighbours are
    never gathered: each round takes their least and joins it back to them. No edges: no rows. A component of diameter d
    needs about log d rounds; not converging within max_rounds raises.
    """
    cur = shelf.keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    if cur.count() <= DRIVER_EDGES:
        return _joined(shelf, cur)
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        large = shelf.keep(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m")).distinct()
        nxt = shelf.keep(nxt)
        now = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        shelf.drop(cur, large)
        cur = nxt
        if now == state:
            roots = cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
        state = now
    raise RuntimeError("components did not converge")
