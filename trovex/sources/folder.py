"""Files of a folder that every executor can read."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions.lang import EXTENSIONS, language_of
from trovex.operators.filters import SKIPPED, ignore_rules, should_index
from trovex.schema import Options
from trovex.shelf import workers_find_us

#: Whether a file is indexed, by (path, bytes, most bytes, rules of the ignore file).
Security = Callable[[Column, Column, int, Sequence[str]], Column]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p)) and bool(fs.getFileStatus(p).isDirectory())


def qualified(spark: SparkSession, path: str) -> str:
    """The folder's full address as Spark reports it."""
    fs, p = _fs(spark, path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return fs.resolvePath(p).toString().rstrip("/")


def _files(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a full address, and the address within it."""
    if base.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + base[5:].lstrip("/")
    return pafs.FileSystem.from_uri(urllib.parse.quote(base, safe=":/"))


def _read(base: str, path: str) -> bytes | None:
    """A file's bytes, or None if it is gone."""
    fs, root = _files(base)
    try:
        with fs.open_input_stream(f"{root}/{path}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _walk(base: str, folders: list[str], deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(path, bytes, nanoseconds of its last change) of the files below folders of base, hidden ones too; skipped folders aren't entered. Not deep: folders are given as (path, -1, 0)."""
    fs, root = _files(base)
    while folders:
        here = folders.pop()
        for x in fs.get_file_info(pafs.FileSelector(f"{root}/{here}".rstrip("/"), allow_not_found=True)):
            path = f"{here}/{x.base_name}".lstrip("/")
            if x.type == pafs.FileType.Directory:
                if x.base_name.lower() in SKIPPED:
                    continue
                if deep:
                    folders.append(path)
                else:
                    yield path, -1, 0
            elif x.type == pafs.FileType.File:
                yield path, x.size, x.mtime_ns or 0


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, changed) of all files below a folder, paths relative with slashes. Names may begin with a dot or an underscore.

    The driver lists the folder itself; what is below is listed in the workers, folder by folder.
    """
    workers_find_us(spark)
    base = qualified(spark, root)
    kinds = "path string, size_bytes bigint, changed bigint"
    first = list(_walk(base, [""], deep=False))
    top = spark.createDataFrame([x for x in first if x[1] >= 0], kinds)
    below = [(x[0],) for x in first if x[1] < 0]
    if not below:
        return top

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(_walk(base, list(batch.folder))), columns=["path", "size_bytes", "changed"])

    parts = min(len(below), spark.sparkContext.defaultParallelism * 4)
    return top.union(spark.createDataFrame(below, "folder string").repartition(parts).mapInPandas(run, kinds))


def ignore_file(spark: SparkSession, root: str) -> list[str]:
    """Rules of the ignore file in the folder itself; none without one."""
    return ignore_rules((_read(qualified(spark, root), ".gitignore") or b"").decode("utf-8", "replace"))


def safe_path(path: str) -> str:
    """A relative path that stays within its root; else raises."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith("/") or ".." in parts or (len(path) > 1 and path[1] == ":"):
        raise PermissionError(f"outside the root: {path}")
    return path


def scan_folder(spark: SparkSession, root: str, options: Options = Options(), repo_key: str | None = None, content: bool = True, cap: bool = True, security: Security = should_index, extensions: Mapping[str, str] = EXTENSIONS) -> DataFrame:
    """(repo_key, path, language, size_bytes, sha, content) of the files to index, paths relative with slashes.

    Names and sizes are filtered on the listing, before any content is read; contents are read in the workers, and a file
    that is gone by then has none. cap keeps the first max_files paths. security takes the place of should_index and
    extensions of the languages.
    """
    base = qualified(spark, root)
    listed = listing(spark, root).where(security(F.col("path"), F.col("size_bytes"), options.max_file_bytes, ignore_file(spark, root)))
    listed = listed.withColumn("language", language_of(F.col("path"), extensions)).where("language is not null").drop("changed")
    if cap:
        listed = listed.orderBy("path").limit(options.max_files)
    key = repo_key if repo_key is not None else base.rsplit("/", 1)[-1]
    if content:
        listed = listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_contents(base), "path string, size_bytes bigint, language string, content string")
    return listed.select(F.lit(key).alias("repo_key"), "path", "language", "size_bytes", F.lit(None).cast("string").alias("sha"), *(["content"] if content else []))


def _contents(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 16):  # a few files at a time
                some = batch.iloc[a : a + 16]
                texts = [None if x is None else x.decode("utf-8", "replace") for x in (_read(base, p) for p in some.path)]
                yield some[["path", "size_bytes", "language"]].assign(content=texts)

    return run


def read_file(spark: SparkSession, root: str, path: str) -> str:
    """Text of one file below the root; a missing one raises."""
    found = _read(qualified(spark, root), safe_path(path))
    if found is None:
        raise FileNotFoundError(path)
    return found.decode("utf-8", "replace")
