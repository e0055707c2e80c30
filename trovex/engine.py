"""The engine: index folders and repositories, and ask the index. Everything but the index's place can be replaced."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.functions.lang import EXTENSIONS
from trovex.operators import context, extract, filters, graph, incremental, outline, search
from trovex.schema import Options, ddl
from trovex.shelf import Shelf
from trovex.sources import folder, git, remote
from trovex.sources.store import Store


class Engine:
    """summarize: a Column function of (signature, kind, qualified_name) that fills empty summaries. client: "module:Class" of a
    remote.Client. store: any object with Store's methods. backend: extract.Backend that finds declarations where it can.
    security: folder.Security in place of should_index. extensions: the language of each file name's ending. guess_edges:
    let names in sources count as references where symbols have none."""

    def __init__(self, spark: SparkSession, options: Options | None = None, store: Store | None = None, client: str = "trovex.sources.remote:WebClient", summarize: Callable[[Column, Column, Column], Column] | None = None, backend: extract.Backend | None = extract.parsed, guess_edges: bool = False, security: folder.Security = filters.should_index, extensions: Mapping[str, str] = EXTENSIONS):
        self.spark, self.options = spark, options or Options()
        self.store = store or Store(spark, self.options.index_path)
        self.client, self.summarize, self.backend, self.guess_edges = client, summarize, backend, guess_edges
        self.rules = {"security": security, "extensions": extensions}

    def index_folder(self, path: str, repo_key: str | None = None) -> dict:
        """Index a folder, or refresh its index: only files whose hash changed are parsed. The row of index_meta is returned."""
        files = folder.scan_folder(self.spark, path, self.options, repo_key, **self.rules)
        key = repo_key or folder.qualified(self.spark, path).rsplit("/", 1)[-1]
        return self._index(key, files, path, True)

    def index_repo(self, repo: str) -> dict:
        """As index_folder, for owner/name at a remote host."""
        return self._index(repo, remote.scan_repository(self.spark, repo, self.client, self.options, **self.rules), repo, False)

    def reindex(self, key: str) -> dict:
        """Refresh from where the index came from."""
        meta = self._tables(key)["index_meta"].first()
        return self.index_folder(meta.repo_url, key) if meta.is_local else self.index_repo(key)

    def _index(self, key: str, files: DataFrame, url: str, local: bool) -> dict:
        began, shelf = time.time(), Shelf(self.spark)
        files = shelf.keep(extract.with_hash(files))
        old = self.store.load(key)
        parse = lambda df: extract.extract_symbols(df, self.backend, self.summarize)
        symbols = parse(files) if old is None else incremental.refreshed(old["symbols"], old["files"], files, parse)
        last = F.max_by(F.struct(*[c for c in symbols.columns if c != "id"]), F.struct("start_line", "byte_start"))
        symbols = shelf.keep(symbols.groupBy("id").agg(last.alias("s")).select("id", "s.*"))  # of repeated identifiers the last is kept
        sources = files.select("repo_key", F.col("path").alias("file_path"), "content")
        edges = graph.edges_of(symbols)
        if self.guess_edges:
            edges = edges.union(extract.name_edges(symbols, sources))
        edges = shelf.keep(edges)
        columns = [c.split(" ")[0] for c in ddl("symbols").split(", ")]
        symbols = graph.with_centrality(symbols, edges).select(*columns)
        manifest = files.select("repo_key", "path", "language", F.col("size_bytes").cast("bigint"), "sha", "file_hash")
        stats = incremental.index_stats(symbols, manifest).first()
        meta = self.spark.createDataFrame([(key, url, local, time.time() - began, stats.symbol_count, stats.file_count, stats.total_bytes)], "repo_key string, repo_url string, is_local boolean, index_seconds double, symbol_count bigint, file_count bigint, total_bytes bigint")
        meta = meta.withColumn("indexed_at", F.current_timestamp()).select(*[c.split(" ")[0] for c in ddl("index_meta").split(", ")])
        self.store.save(key, {"symbols": symbols, "files": manifest, "raw_source": sources, "index_meta": meta, "edges": edges})
        return self.store.load(key)["index_meta"].first().asDict()

    def _tables(self, key: str) -> dict[str, DataFrame]:
        tables = self.store.load(key)
        if tables is None:
            raise LookupError(f"no index of {key!r}")
        return tables

    def repos(self) -> list[str]:
        return self.store.keys()

    def invalidate(self, key: str) -> bool:
        return self.store.delete(key)

    def search_symbols(self, key: str, query: str, kind: str | None = None, language: str | None = None, k: int = 20) -> DataFrame:
        return search.search_symbols(self._tables(key)["symbols"], query, kind, language, k, self.options.fuzzy_threshold)

    def search_text(self, key: str, needle: str, k: int = 20) -> DataFrame:
        t = self._tables(key)
        return search.search_text(t["symbols"], t["raw_source"], needle, k)

    def symbol_source(self, key: str, id: str) -> str | None:
        t = self._tables(key)
        row = context.symbol_sources(t["symbols"].where(F.col("id") == id), t["raw_source"]).select("source").first()
        return row[0] if row else None

    def symbols_with_source(self, key: str, ids: list[str]) -> DataFrame:
        t = self._tables(key)
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos bigint, id string")
        return context.batch_sources(wanted, t["symbols"], t["raw_source"])

    def ranked_context(self, key: str, query: str, budget: int = 4000) -> DataFrame:
        t = self._tables(key)
        found = search.search_symbols(t["symbols"], query, k=context.CANDIDATES, threshold=self.options.fuzzy_threshold)
        return context.ranked_context(found, t["symbols"], t["raw_source"], query, budget)

    def repo_outline(self, key: str) -> DataFrame:
        return outline.outline(self._tables(key)["symbols"]).orderBy("file_path", "start_line", "id")

    def file_outline(self, key: str, path: str) -> DataFrame:
        return outline.file_outline(self._tables(key)["symbols"], path)

    def file_tree(self, key: str, prefix: str | None = None) -> DataFrame:
        return outline.file_tree(self._tables(key)["files"], prefix)

    def importance(self, key: str, k: int = 20) -> DataFrame:
        return graph.importance(self._tables(key)["symbols"], k)

    def dead_code(self, key: str) -> DataFrame:
        t = self._tables(key)
        return graph.dead_symbols(t["symbols"], t["edges"])

    def blast_radius(self, key: str, id: str, depth: int = 3) -> DataFrame:
        t = self._tables(key)
        return graph.blast_radius(t["edges"], id, depth).join(t["symbols"], "id").orderBy("depth", "id")

    def changed_symbols(self, key: str, old: str, new: str) -> DataFrame:
        t = self._tables(key)
        meta = t["index_meta"].first()
        if not meta.is_local:
            raise LookupError(f"{key!r} isn't a local repository")
        return graph.changed_symbols(t["symbols"], git.changed_files(self.spark, meta.repo_url, old, new))

    def resolve(self, given: str | None = None, at: str | None = None) -> str:
        return filters.resolve_repo(self.repos(), given, at)
