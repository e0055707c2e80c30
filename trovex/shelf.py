"""Tables between steps, kept in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch that goes to a Python worker; Spark's own bound is eight times this.
BATCH_BYTES = 8 << 20
#: Without these, workers keep most of what their largest batch took.
_MALLOC = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's paths; elsewhere ship it with --py-files.

    Workers are also told to hold little memory, and the session to send them small batches unless it sets a size itself.
    """
    spark.sparkContext.environment.update({"PYTHONPATH": str(Path(__file__).resolve().parents[1]), **_MALLOC})
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares. Where none is set, a local master uses a temporary one and a cluster raises."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if re.fullmatch(r"local(\[.*\])?", sc.master):
            base = tempfile.mkdtemp(prefix="trovex-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/trovex-{uuid.uuid4().hex}"


class Shelf:
    """Tables that one run keeps in the shared folder, so that lost executors cost a read and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame, codec: str = "lz4", *more: DataFrame, by: str | None = None) -> DataFrame:
        """df as a table, and more after it, written one after another so that each one's shuffle files go before the next begins. by: a folder for each value of this column."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # once the table is there, nobody reads its shuffle files
        try:
            for part in (df, *more):
                part.write.option("compression", codec).mode("append").partitionBy(*[by] * bool(by)).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    @property
    def last(self) -> str:
        """The full address of the table that was kept last."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{self.n}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(d)
                path.getFileSystem(conf).delete(path, True)
