"""Re-indexing as files change: file events are grouped into quiet-ended sessions, each of which refreshes the index once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovex.operators.incremental import manifest_diff
from trovex.sources.folder import exists, listing

QUIET = "2 seconds"
_MANIFEST = "path string, file_hash string"


def sessions(events: DataFrame, ts: str = "ts", gap: str = QUIET, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """(by, start_ts, fire_ts, events): bursts of events with no pause of gap; each fires a gap after its last event.

    The same for batches and streams; a stream needs late, for how long events may be overdue, and gives a burst once
    its time has passed. ts may be without a zone.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    grouped = timed.groupBy(*(by or []), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(*(by or []), F.col("w.start").alias("start_ts"), F.col("w.end").alias("fire_ts"), "events")


class FolderWatcher:
    """Calls refresh(batch_id) once after each burst of changes below root: files made, written, removed or renamed.

    Every tick of a stream lists the folder and compares path, length and time with the listing before. A change starts the
    quiet time anew; once it has passed without another, refresh is called. The listing of the last refresh is kept below
    checkpoint, so that changes while nobody watched count after the next start; the first listing of all counts as one
    change. start is idempotent; stop ends the stream and forgets what is pending.
    """

    def __init__(self, spark: SparkSession, root: str, refresh: Callable[[int], None], checkpoint: str, quiet: float = 2.0):
        self.spark, self.root, self.refresh, self.checkpoint, self.quiet = spark, root, refresh, checkpoint.rstrip("/"), quiet
        self.query: StreamingQuery | None = None
        self.seen: DataFrame | None = None
        self.changed_at: float | None = None
        self.slot = 0

    def _before(self) -> DataFrame:
        if self.seen is None:
            at = f"{self.checkpoint}/manifest"
            self.seen = self.spark.read.schema(_MANIFEST).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], _MANIFEST)
        return self.seen

    def _kept(self, rows: DataFrame, at: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(_MANIFEST).parquet(at)

    def poll(self, batch_id: int = 0, now: float | None = None) -> dict[str, int]:
        """One tick: how many files were added, modified and deleted since the tick before. It calls refresh if quiet has passed."""
        now = time.monotonic() if now is None else now
        before = self._before()
        here = listing(self.spark, self.root).select("path", F.concat_ws(":", "size_bytes", "changed").alias("file_hash"))
        here = self._kept(here, f"{self.checkpoint}/seen-{1 - self.slot}")
        changes = {r["status"]: r["count"] for r in manifest_diff(before, here).where("status <> 'unchanged'").groupBy("status").count().collect()}  # three rows at most
        if changes:
            self.seen, self.changed_at, self.slot = here, now, 1 - self.slot
        elif self.changed_at is not None and now - self.changed_at >= self.quiet:
            self.changed_at = None
            self._kept(here, f"{self.checkpoint}/manifest")
            self.refresh(batch_id)
        return changes

    def start(self) -> StreamingQuery:
        if self.query is None or not self.query.isActive:
            ticks = self.spark.readStream.format("rate").load().writeStream.foreachBatch(lambda _, batch_id: self.poll(batch_id) and None)
            self.query = ticks.trigger(processingTime=f"{max(1, round(self.quiet * 500))} milliseconds").start()
        return self.query

    def stop(self) -> None:
        self.changed_at = None
        if self.query is not None:
            self.query.stop()


def merge_manifest(old: DataFrame, seen: DataFrame, deleted: Column | None = None) -> DataFrame:
    """The newest row of each path of two listings(path, file_hash, ts): what a stream of listings keeps as its state."""
    both = old.unionByName(seen)
    newest = both.groupBy("path").agg(F.max_by(F.struct(*[c for c in both.columns if c != "path"]), "ts").alias("r")).select("path", "r.*")
    return newest if deleted is None else newest.where(~deleted)
