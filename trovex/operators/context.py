"""Sources of symbols, and bundles of them within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.functions import text as tx

CANDIDATES = 50


def symbol_sources(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """symbols with their source, cut from the file's bytes; null without the file."""
    files = sources.select("repo_key", "file_path", "content")
    return symbols.join(files, ["repo_key", "file_path"], "left").withColumn("source", tx.byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end"))).drop("content")


def batch_sources(ids: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(pos, symbol columns, source) of ids(pos, id) in their order, repeats kept and unknown ones skipped; the signature where there is no source."""
    found = symbol_sources(symbols.join(F.broadcast(ids) if ids.count() < 100_000 else ids, "id"), sources)
    return found.withColumn("source", F.coalesce("source", "signature")).orderBy("pos")


def packed(ranked: DataFrame, budget: int, tokens: str = "tokens", id: str = "id", group: str | None = None) -> DataFrame:
    """(id, tokens, pos) that fit the budget: best score first, one that doesn't fit is skipped and later ones may still fit.

    ranked has a few rows (CANDIDATES at most in a context): they are folded within one array.
    """
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id).alias("id"), F.col(tokens).cast("long").alias("tokens"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<id:{ranked.schema[id].dataType.simpleString()},tokens:bigint>>").alias("taken"))
    step = lambda acc, x: F.when(acc.used + x.tokens <= budget, F.struct((acc.used + x.tokens).alias("used"), F.array_append(acc.taken, F.struct(x.id.alias("id"), x.tokens.alias("tokens"))).alias("taken"))).otherwise(acc)
    one = ranked.groupBy(*([group] if group else [])).agg(items.alias("items")).select(*([group] if group else []), F.aggregate("items", start, step).alias("fit"), F.size("items").alias("n"))
    return one.select(*([group] if group else []), F.posexplode("fit.taken").alias("pos", "t"), "n", F.col("fit.used").alias("used")).select(*([group] if group else []), F.col("t.id").alias("id"), F.col("t.tokens").alias("tokens"), (F.col("pos") + 1).alias("pos"), F.col("used").alias("used_tokens"), (F.col("n") - F.size(F.array()) - F.count(F.lit(1)).over(_all(group))).cast("int").alias("excluded"))


def _all(group: str | None):
    from pyspark.sql import Window

    return Window.partitionBy(group if group else F.lit(0))


def ranked_context(found: DataFrame, symbols: DataFrame, sources: DataFrame, query: str, budget: int = 4000) -> DataFrame:
    """One row (query, symbols, budget_tokens, used_tokens, excluded_count) from search results found(id, score, ...)."""
    best = found.orderBy(F.desc("score"), "id").limit(CANDIDATES).withColumn("tokens", tx.token_estimate(F.col("byte_start"), F.col("byte_end")))
    fit = packed(best, budget)
    parts = symbol_sources(best.drop("tokens").join(F.broadcast(fit), "id"), sources).withColumn("source", F.coalesce("source", "signature"))  # CANDIDATES rows at most
    one = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "kind", "file_path", "tokens", "source"))).alias("symbols"), F.max("used_tokens").alias("used_tokens"))
    n = best.agg(F.count(F.lit(1)).alias("n"))
    return one.crossJoin(F.broadcast(n)).select(F.lit(query).alias("query"), "symbols", F.lit(budget).alias("budget_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), (F.col("n") - F.size("symbols")).cast("int").alias("excluded_count"))
