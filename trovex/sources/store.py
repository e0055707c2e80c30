"""The index as Parquet tables below one folder, partitioned by repository; a version is complete before it is seen.

Every save writes a new version folder and then moves one small pointer file over the old, so a reader sees the old
index or the new one. The version before the current one is kept, earlier ones are removed: who loads an index has to be
done with it by the second save after.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.schema import Options, ddl

TABLES = ("symbols", "files", "raw_source", "index_meta", "edges")


class Store:
    """load, save, delete and list indexes; tables are DataFrames without their repository's path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or Options().index_path).rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _home(self, key: str) -> str:
        return f"{self.path}/{urllib.parse.quote(key, safe='')}"

    def _version(self, key: str) -> str | None:
        fs, p = self._fs(f"{self._home(key)}/current.json")
        if not fs.exists(p):
            return None
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self._home(key)}/current.json").collect())
        return json.loads(text)["version"]  # a damaged pointer raises

    def load(self, key: str) -> dict[str, DataFrame] | None:
        """The tables of a repository, or None if it has no index. A damaged index raises."""
        version = self._version(key)
        if version is None:
            return None
        return {t: self.spark.read.schema(ddl(t)).parquet(f"{self._home(key)}/{version}/{t}") for t in TABLES}

    def save(self, key: str, tables: dict[str, DataFrame]) -> None:
        """Write all tables as a new version, then let it be the current one."""
        version, old = uuid.uuid4().hex, self._version(key)
        for t in TABLES:
            df = tables.get(t)
            if df is None:
                df = self.spark.createDataFrame([], ddl(t))
            df.write.parquet(f"{self._home(key)}/{version}/{t}")
        fs, new = self._fs(f"{self._home(key)}/next-{version}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"version": version, "key": key}), "utf-8"))
        out.close()
        _, pointer = self._fs(f"{self._home(key)}/current.json")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        rename = getattr(context, "Options$Rename").OVERWRITE
        modes = self.spark.sparkContext._gateway.new_array(getattr(context, "Options$Rename"), 1)
        modes[0] = rename
        context.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(new), fs.makeQualified(pointer), modes)
        for status in fs.listStatus(self._fs(self._home(key))[1]):
            name = status.getPath().getName()
            if status.isDirectory() and name not in (version, old):
                fs.delete(status.getPath(), True)

    def delete(self, key: str) -> bool:
        """Remove a repository's index; False if there was none."""
        fs, p = self._fs(self._home(key))
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def keys(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(urllib.parse.unquote(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory() and fs.exists(self._fs(f"{s.getPath().toString()}/current.json")[1]))

    def raw_source(self, key: str, path: str) -> str | None:
        """One file's text as it was indexed, or None."""
        tables = self.load(key)
        row = tables["raw_source"].where(F.col("file_path") == path).select("content").first() if tables else None
        return row[0] if row else None

    def export_json(self, key: str, path: str) -> None:
        """The symbols as JSON lines, nulls left out."""
        write_json(self.load(key)["symbols"], path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines below path, nulls left out."""
    rows.write.mode("overwrite").json(path)
