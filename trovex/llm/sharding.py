"""Operator 9: sharding by minimax contiguous partition.

Atomic groups in order are cut into at most so many shards that the largest is as small as it can be: the smallest
feasible capacity is found by bisection, each time filling shards greedily. Here a group is all documents with one
text, so that copies never part; groups are in the order of their smallest identifier.

The sums of group sizes up to each group lie in a table sorted by them. The greedy fill needs only, a few times per
shard, the last such sum within reach. The driver holds ranges of sums (cells); a fill is followed for the least and the
most that the cells allow, and only cells in which the two part are read in finer cells, until both agree. So what the
driver holds follows the number of shards, and the fill is exact whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm.shared import Shelf, col

#: Cells that a cell is split into when it is read in finer ones.
FINER = 512


@dataclass(frozen=True)
class Shards:
    """number: of shards at most. Sizes are bytes of text."""

    number: int = 64


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = pc.add(pc.cumulative_sum(batch.column(2)), total)
        total = upto[-1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([number] * batch.num_rows, pa.int32()), upto], names=["seal", "head", "size", "number", "upto"])


class Cells:
    """Ranges of the sorted sums, each with its first and last sum; finer ones are read as they are needed."""

    def __init__(self, sums: DataFrame, total: int):
        self.sums, self.total = sums, total
        self.first, self.last = [], []
        self._read([(1, total)])

    def _read(self, ranges: list[tuple[int, int]]) -> None:
        spark = self.sums.sparkSession
        cells = spark.createDataFrame([(a, b, max(1, -(-(b - a + 1) // FINER))) for a, b in ranges], "a bigint, b bigint, width bigint")
        least, most = min(a for a, _ in ranges), max(b for _, b in ranges)
        near = self.sums.where((F.col("upto") >= least) & (F.col("upto") <= most)).join(F.broadcast(cells), (F.col("upto") >= F.col("a")) & (F.col("upto") <= F.col("b")))  # cells: two per shard at most
        found = near.groupBy("a", F.expr("(upto - a) div width").alias("k")).agg(F.min("upto").alias("first"), F.max("upto").alias("last")).collect()  # FINER rows per cell at most
        old = {(a, b) for a, b in ranges}
        kept = [(a, b) for a, b in zip(self.first, self.last) if (a, b) not in old]
        both = sorted([*kept, *((r["first"], r["last"]) for r in found)])
        self.first, self.last = [a for a, _ in both], [b for _, b in both]

    def _next(self, low: int, high: int, unsure: set[tuple[int, int]]) -> tuple[int, int]:
        """Least and most of the last sum that is at most v, for a v from low to high; 0 if there is none."""
        i, j = bisect_right(self.first, low) - 1, bisect_right(self.first, high) - 1
        a = b = 0
        if i >= 0:
            a = self.last[i] if self.last[i] <= low else self.first[i]
            if self.last[i] > low:
                unsure.add((self.first[i], self.last[i]))
        if j >= 0:
            b = min(self.last[j], high)
            if self.last[j] > high:
                unsure.add((self.first[j], self.last[j]))
        return a, b

    def fill(self, capacity: int, number: int) -> list[int] | None:
        """The sums at which shards of the capacity end, or None if number shards don't hold all."""
        while True:
            low = high = 0
            ends, unsure, exact = [], set(), True
            for _ in range(number):
                low, high = self._next(low + capacity, high + capacity, unsure)
                ends.append(low)
                exact &= low == high
                if low >= self.total:
                    break
            if high < self.total:
                return None
            if exact:
                return ends if low >= self.total else None
            self._read(sorted(x for x in unsure if x[0] < x[1]))


def capacity(cells: Cells, largest: int, number: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, ends of its shards): at least the largest group and the mean, at most their sum."""
    low = max(largest, -(-cells.total // number))
    high = -(-cells.total // number) + largest
    while low < high:
        mid = (low + high) // 2
        if cells.fill(mid, number) is None:
            low = mid + 1
        else:
            high = mid
    return low, cells.fill(low, number)


def assigned(docs: DataFrame, cfg: Shards = Shards(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, shard, size) of every row: the number of its shard from 0, and its bytes.

    Rows with one text are one group, and so are all rows with a null text; null and empty texts have size 0, and a group
    without bytes goes with the groups before it. Groups are in the order of their smallest identifier, groups with null
    identifiers alone at the end, then by digest. Shards are filled greedily to the smallest capacity, so later ones may be
    smaller or missing. Repeated rows are in one shard. Other columns are dropped. An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    t = col(docs, text).cast("string")
    slim = shelf.keep(docs.select(col(docs, id).alias("id"), F.coalesce(F.md5(t), F.lit("")).alias("seal"), F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint").alias("size")))
    groups = slim.groupBy("seal").agg(F.min("id").alias("head"), F.sum("size").alias("size"))
    order = [F.col("head").asc_nulls_last(), F.col("seal")]
    ranged = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = docs.schema[id].dataType.simpleString()
    runs = shelf.keep(ranged.select("seal", "head", "size").mapInArrow(_running, f"seal string, head {kind}, size bigint, number int, upto bigint"))
    parts = runs.groupBy("number").agg(F.max("upto").alias("sum"), F.max("size").alias("largest")).orderBy("number").collect()  # a row per partition
    total, largest, before = 0, 0, {}
    for p in parts:
        before[p["number"]] = total
        total, largest = total + p["sum"], max(largest, p["largest"])
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "number int, before bigint")
    sums = runs.join(F.broadcast(offsets), "number").select("seal", (F.col("upto") + F.col("before")).alias("upto"))  # offsets: a row per partition
    if total:
        sums = shelf.keep(sums)
        cells = Cells(sums.where("upto > 0").select("upto"), total)
        _, ends = capacity(cells, largest, cfg.number)
    else:
        ends = []
    cuts = F.array(*[F.lit(e).cast("bigint") for e in ends[:-1]]) if len(ends) > 1 else F.array().cast("array<bigint>")
    placed = sums.select("seal", F.size(F.filter(cuts, lambda e: e < F.col("upto"))).alias("shard"))
    return slim.join(placed, "seal").select(F.col("id").alias(id), "shard", "size")
