"""Graph analyses over edges(src_id, dst_id): importance, dead code, blast radius and changed symbols."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.shelf import Shelf, workers_find_us
from trovex.sources.folder import _files

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Nodes whose shares a worker holds at once, 8 bytes each.
BLOCK = 2_000_000
DEAD_REASON = "No incoming references detected"


def edges_of(symbols: DataFrame) -> DataFrame:
    """(src_id, dst_id) for every reference, repeats kept."""
    return symbols.select(F.col("id").alias("src_id"), F.explode("references").alias("dst_id"))


def pagerank(nodes: DataFrame, edges: DataFrame, id: str = "id", damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, scaled: bool = True) -> DataFrame:
    """(id, rank): rounds until the ranks' total change is below the tolerance; scaled so that the greatest is 1.

    An edge counts as often as it occurs; edges to or from unknown nodes count for nothing. A node without an edge out of
    it gives its rank to all nodes alike, by one number per round. Each round is a table in the shared folder.

    Nodes are numbered, and links lie sorted by BLOCKs of their sources and by targets once and for all. A round reads them
    where they lie, with one block's shares in memory, so what it shuffles is a row per node and block, not per link.
    """
    shelf = Shelf(nodes.sparkSession)
    workers_find_us(nodes.sparkSession)
    ids, n = _numbered(nodes.select(F.col(id).alias("id")).distinct(), shelf)
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    ends = lambda end, to: ids.select(F.col("id").alias(end), F.col("n").alias(to))
    links = edges.select("src_id", "dst_id").join(ends("src_id", "src"), "src_id").select("dst_id", "src").join(ends("dst_id", "dst"), "dst_id")
    links = shelf.keep(links.select("src", "dst").sortWithinPartitions(F.floor(F.col("src") / BLOCK), "dst"))
    deg = links.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    block = F.floor(F.col("n") / BLOCK).alias("block")
    share = F.coalesce(F.col("rank") / F.col("deg"), F.lit(0.0)).alias("share")
    # snappy: pyarrow can't read larger blocks of Spark's lz4
    cur = shelf.keep(ids.select("n").join(deg, "n", "left").withColumn("rank", F.lit(1.0 / n)).select("n", "deg", "rank", share, F.lit(0.0).alias("moved"), block), "snappy", by="block")
    for _ in range(rounds):
        lost = cur.where("deg is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = links.mapInArrow(_gathered(shelf.last, BLOCK), "n bigint, part double").groupBy("n").agg(F.sum("part").alias("got"))
        rank = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        nxt = cur.select("n", "deg", F.col("rank").alias("old")).join(given, "n", "left").crossJoin(F.broadcast(lost))  # lost: one row
        nxt = nxt.select("n", "deg", rank.alias("rank"), F.abs(rank - F.col("old")).alias("moved"))
        nxt = shelf.keep(nxt.select("n", "deg", "rank", share, "moved", block), "snappy", by="block")
        moved = nxt.agg(F.sum("moved")).first()[0] if tolerance > 0 else None
        shelf.drop(cur)
        cur = nxt
        if moved is not None and moved < tolerance:
            break
    cur = ids.join(cur.select("n", "rank"), "n").select("id", "rank")
    if not scaled:
        return cur
    most = cur.agg(F.max("rank").alias("most"))
    return cur.crossJoin(F.broadcast(most)).select("id", F.when(F.col("most") > 0, F.col("rank") / F.col("most")).otherwise(0.0).alias("rank"))  # one row


def _numbered(ids: DataFrame, shelf: Shelf) -> tuple[DataFrame, int]:
    """(id, n) with numbers from 0 without gaps, and how many there are. A row per partition comes to the driver."""
    low = (1 << 33) - 1  # the bits that count a partition's rows
    kept = shelf.keep(ids.withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted(map(tuple, kept.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1))).collect()))
    ahead = list(itertools.accumulate((k for _, k in sizes), initial=0))
    if not ahead[-1]:
        return kept.select("id", F.col("at").alias("n")), 0
    before = ids.sparkSession.createDataFrame(pa.table({"part": [p for p, _ in sizes], "ahead": ahead[:-1]}))
    found = kept.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")  # a row per partition
    return shelf.keep(found.select("id", (F.col("ahead") + F.col("at").bitwiseAND(F.lit(low))).alias("n"))), ahead[-1]


def _gathered(path: str, size: int):
    """Of links (src, dst) a row (n, part) for each run of one target: the sum of its sources' shares, which lie in path by blocks of so many nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shares = -1, np.zeros(0)
        for batch in batches:
            src, dst = (batch.column(c).to_numpy() for c in ("src", "dst"))
            blocks = src // size
            got = np.empty(len(src))
            for block in np.unique(blocks).tolist():
                if block != held:
                    shares, held = np.zeros(0), -1
                    shares, held = _shares(f"{path}/block={block}", block * size, size), block
                here = blocks == block
                got[here] = shares[src[here] - block * size]
            begins = np.flatnonzero(np.diff(dst, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(dst[begins]), pa.array(np.add.reduceat(got, begins) if len(begins) else got)], names=["n", "part"])

    return run


def _shares(path: str, first: int, size: int) -> np.ndarray:
    """The shares of nodes first to first + size, 0 for those that aren't there."""
    fs, at = _files(path)
    shares = np.zeros(size)
    for f in fs.get_file_info(FileSelector(at)):
        if f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_")):
            with fs.open_input_file(f.path) as opened:
                some = pq.read_table(opened, columns=["n", "share"])
            shares[some["n"].to_numpy() - first] = some["share"].to_numpy()
    return shares


def with_centrality(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """symbols with centrality_score set by pagerank."""
    ranks = pagerank(symbols, edges).withColumnRenamed("rank", "centrality_score")
    return symbols.drop("centrality_score").join(ranks, "id", "left").select(*symbols.columns)


def importance(symbols: DataFrame, k: int = 20, id: str = "id", score: str = "centrality_score") -> DataFrame:
    return symbols.withColumns({"score": F.col(score), "match_type": F.lit("Exact")}).orderBy(F.desc("score"), F.asc(id)).limit(k)


def dead_symbols(symbols: DataFrame, edges: DataFrame, id: str = "id", kind: str | None = "kind") -> DataFrame:
    """symbols that no edge leads to, with a reason; classes and interfaces are never dead, and a reference to itself counts."""
    some = symbols.where(~F.col(kind).isin("Class", "Interface")) if kind else symbols
    return some.join(edges.select(F.col("dst_id").alias(id)).distinct(), id, "left_anti").withColumn("reason", F.lit(DEAD_REASON))


def blast_radius(edges: DataFrame, start: object, depth: int = 3) -> DataFrame:
    """(id, depth) of all nodes that lead to start in at most so many steps, with the fewest; start itself is left out.

    One join per step: the frontier with the edges reversed, less what was seen. A node that occurs only in edges is a node too.
    """
    spark, shelf = edges.sparkSession, Shelf(edges.sparkSession)
    kind = edges.schema["dst_id"].dataType.simpleString()
    seen = spark.createDataFrame([(start,)], f"id {kind}").withColumn("depth", F.lit(0))
    frontier = seen
    links = shelf.keep(edges.select(F.col("src_id"), F.col("dst_id")).distinct())
    for d in range(1, depth + 1):
        found = links.join(frontier.select(F.col("id").alias("dst_id")), "dst_id").select(F.col("src_id").alias("id")).where("id is not null").distinct()
        frontier = shelf.keep(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def changed_symbols(symbols: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """symbols of changed files with change: added, deleted, or modified for every other status."""
    low = F.lower("status")
    sort = F.when(low.isin("added", "a"), "added").when(low.isin("deleted", "d"), "deleted").otherwise("modified")
    return symbols.join(changes.select(F.col("path").alias(path), sort.alias("change")).distinct(), path)
