"""Repositories behind an interface, as a Spark data source: one row per file, contents read in the workers."""

from __future__ import annotations

import importlib
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trovex.functions.lang import EXTENSIONS, language_of
from trovex.operators.filters import should_index
from trovex.schema import Options
from trovex.shelf import workers_find_us
from trovex.sources.folder import Security


class Client(Protocol):
    """What a host of repositories must offer. Clients are made anew in each worker from the option client: module:Class."""

    def exists(self, repo: str) -> bool: ...

    def files(self, repo: str) -> list[tuple[str, int, str | None]]:
        """(path, bytes, blob hash) of every file of the default branch."""

    def content(self, repo: str, path: str) -> str: ...


class WebClient:
    """A client of the public REST interface for git trees. The token is optional, from the environment."""

    def __init__(self, base: str = "https://api.github.com", token: str | None = None):
        self.base, self.token = base.rstrip("/"), token or os.environ.get("GITHUB_TOKEN")

    def _get(self, path: str, raw: bool = False) -> object:
        head = {"Accept": "application/vnd.github.raw" if raw else "application/vnd.github+json"}
        if self.token:
            head["Authorization"] = f"Bearer {self.token}"
        with urllib.request.urlopen(urllib.request.Request(f"{self.base}/{path}", headers=head), timeout=30) as r:  # noqa: S310
            data = r.read()
        return data.decode("utf-8", "replace") if raw else json.loads(data)

    def exists(self, repo: str) -> bool:
        try:
            self._get(f"repos/{repo}")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return False
            raise
        return True

    def files(self, repo: str) -> list[tuple[str, int, str | None]]:
        branch = self._get(f"repos/{repo}")["default_branch"]
        tree = self._get(f"repos/{repo}/git/trees/{urllib.parse.quote(branch, safe='')}?recursive=1")
        return [(x["path"], x.get("size", 0), x.get("sha")) for x in tree["tree"] if x["type"] == "blob"]

    def content(self, repo: str, path: str) -> str:
        return self._get(f"repos/{repo}/contents/{urllib.parse.quote(path)}", raw=True)


def client_of(name: str) -> Client:
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, str | None]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.name, self.batch = options["repo"], options.get("client", "trovex.sources.remote:WebClient"), int(options.get("batch", "100"))
        self.files = json.loads(options["files"]) if "files" in options else None
        self.content = options.get("content", "true") == "true"

    def partitions(self) -> list[_Part]:
        files = client_of(self.name).files(self.repo) if self.files is None else self.files
        return [_Part(files[i : i + self.batch]) for i in range(0, len(files), self.batch)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        client = client_of(self.name)
        for path, size, sha in part.files:
            yield self.repo, path, size, sha, client.content(self.repo, path) if self.content else None


class RepositorySource(DataSource):
    """format("trovex_repository") with options repo, client, batch (files per partition), content, and files: a JSON list of (path, bytes, hash) that saves asking for the tree."""

    @classmethod
    def name(cls) -> str:
        return "trovex_repository"

    def schema(self) -> str:
        return "repo_key string, path string, size_bytes bigint, sha string, content string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def scan_repository(spark: SparkSession, repo: str, client: str = "trovex.sources.remote:WebClient", options: Options = Options(), security: Security = should_index, extensions: Mapping[str, str] = EXTENSIONS) -> DataFrame:
    """As scan_folder: the tree is asked for once and filtered first, and only the contents of files to index are fetched."""
    workers_find_us(spark)
    spark.dataSource.register(RepositorySource)
    if not client_of(client).exists(repo):
        raise FileNotFoundError(repo)
    source = lambda: spark.read.format("trovex_repository").option("repo", repo).option("client", client)  # noqa: E731  # a reader keeps the options it was given
    listed = source().option("content", "false").load().where(security(F.col("path"), F.col("size_bytes"), options.max_file_bytes, ())).where(language_of(F.col("path"), extensions).isNotNull())
    files = [(r.path, r.size_bytes, r.sha) for r in listed.select("path", "size_bytes", "sha").orderBy("path").limit(options.max_files).collect()]  # max_files at most
    return source().option("files", json.dumps(files)).load().withColumn("language", language_of(F.col("path"), extensions)).select("repo_key", "path", "language", "size_bytes", "sha", "content")
