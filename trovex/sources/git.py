"""Changed files between two commits, from git on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from trovex.schema import ddl

_STATUS = {"A": "added", "D": "deleted"}


def changed_files(spark: SparkSession, folder: str, old: str, new: str) -> DataFrame:
    """(path, status) of files that differ, renames under their new path as modified. git's failure raises."""
    out = subprocess.run(["git", "-C", folder, "diff", "--name-status", "-z", "-M", old, new, "--"], capture_output=True, check=True).stdout.decode()
    parts, rows = out.split("\0"), []
    i = 0
    while i < len(parts) - 1:
        mark = parts[i]
        moved = mark[:1] in "RC"
        rows.append((parts[i + 1 + moved], _STATUS.get(mark[:1], "modified")))
        i += 2 + moved
    return spark.createDataFrame(rows, ddl("changes"))
