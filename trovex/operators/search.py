"""Ranked search: BM25, fuzzy names, reciprocal-rank fusion, and counts of a text.

BM25 over whole texts needs no shuffle of documents: for the few terms of a query, frequencies are counted within each
row, document frequencies are one aggregate of one row, and scores are expressions over it. For repeated queries an
index of postings, partitioned by term, takes the tokenizing away.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from trovex.functions import fuzzy as fz
from trovex.functions import text as tx
from trovex.operators.filters import narrowed
from trovex.shelf import Shelf, workers_find_us

K1, B = 1.2, 0.4
RRF_K, W_BM25, W_FUZZY = 60, 1.0, 0.5
BUCKETS = 256
#: Rows of (id, score) that are ranked in one task.
ONE_TASK = 100_000
#: Repeated ids up to this number are broadcast.
MANY = 100_000
#: Rows of an Arrow batch that counting gives back.
OUT_ROWS = 50_000


def _idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _count(tokens: str, term: str) -> Column:
    return (F.size(tokens) - F.size(F.array_remove(tokens, term))).cast("double")


def bm25(docs: DataFrame, query: str, text: Column, id: str = "id") -> DataFrame:
    """(id, score) of docs for the query, those above 0. Statistics are of docs as given: filter first what isn't to count.

    A term that is in the query twice counts twice. No term or no document: no rows. Texts are read and cut once: what
    is kept of each is its length and its counts of the query's terms.
    """
    terms = Counter(tx.query_tokens(query))
    if not terms:
        return docs.select(id, F.lit(0.0).alias("score")).where("false")
    toks = docs.select(F.col(id), tx.tokens(text).alias("_toks"))
    counted = Shelf(docs.sparkSession).keep(toks.select(id, F.size("_toks").cast("double").alias("_len"), *[_count("_toks", t).alias(f"_tf{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(terms))])
    score, hit = F.lit(0.0), F.lit(False)
    for i, m in enumerate(terms.values()):
        score = score + F.when(F.col(f"_tf{i}") > 0, F.lit(float(m)) * _idf(F.col("_n"), F.col(f"_df{i}")) * _saturated(F.col(f"_tf{i}"), F.col("_len"), F.col("_mean"))).otherwise(0.0)
        hit = hit | (F.col(f"_tf{i}") > 0)
    # stats is one row
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(id, score.alias("score")).where("score > 0")


def counted(docs: DataFrame, text: Column, *kept: str | Column) -> DataFrame:
    """(*kept, len, term, tf): the terms of each row of docs with their counts, made within the row and so without a shuffle; len counts repeats too."""
    workers_find_us(docs.sparkSession)
    toks = docs.select(*kept, tx.tokens(text).alias("_toks"))
    names = toks.drop("_toks").schema
    return toks.mapInArrow(_counts, StructType([*names, StructField("len", IntegerType()), StructField("term", StringType()), StructField("tf", IntegerType())]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toks, kept = batch.column(batch.num_columns - 1), batch.columns[:-1]
        lens = np.diff(toks.offsets.to_numpy())
        terms = toks.flatten().dictionary_encode()
        many = max(1, len(terms.dictionary))
        keys, tf = np.unique(np.repeat(np.arange(len(lens)), lens) * many + terms.indices.to_numpy(), return_counts=True)
        for at in range(0, len(keys), OUT_ROWS):
            row, term = np.divmod(keys[at : at + OUT_ROWS], many)
            cols = [*[c.take(pa.array(row)) for c in kept], pa.array(lens[row], pa.int32()), terms.dictionary.take(pa.array(term)), pa.array(tf[at : at + OUT_ROWS], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "len", "term", "tf"])


def term_counts(docs: DataFrame, text: Column, id: str = "id") -> DataFrame:
    """(id, term, tf) over all rows of an id. Only ids that are repeated are shuffled with their counts, or all if those are more than MANY."""
    at, again = F.col(id), Shelf(docs.sparkSession).keep(docs.groupBy(F.col(id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"))
    each = lambda some: counted(some, text, at).select(id, "term", "tf")
    whole = lambda some: each(some).groupBy(id, "term").agg(F.sum("tf").cast("int").alias("tf"))
    repeated = again.count()
    if not repeated:
        return each(docs)
    if repeated > MANY:
        return whole(docs)
    same = at.eqNullSafe(F.col("_id"))
    return each(docs.join(F.broadcast(again), same, "left_anti")).union(whole(docs.join(F.broadcast(again), same, "left_semi")))  # MANY rows


def postings(docs: DataFrame, text: Column, id: str = "id") -> DataFrame:
    """(bucket, term, id, doc, tf, len): write it partitioned by bucket, so that a query reads its terms' buckets alone. doc tells rows of one id apart."""
    each = counted(docs, text, F.col(id).alias("id"), F.monotonically_increasing_id().alias("doc"))
    return each.select(bucket_of(F.col("term")).alias("bucket"), "term", "id", "doc", "tf", "len")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row (n, mean): documents and their mean number of tokens, repeats included."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size(tx.tokens(text))).alias("mean"))


def bm25_indexed(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(id, score) from postings and corpus_stats; the same scores and rows as bm25."""
    spark = index.sparkSession
    terms = Counter(tx.query_tokens(query))
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).where("false")
    wanted = spark.createDataFrame([(t, float(m)) for t, m in terms.items()], "term string, m double")
    buckets = [r.b for r in wanted.select(bucket_of(F.col("term")).alias("b")).distinct().collect()]  # as many as the query has terms
    hits = index.where(F.col("bucket").isin(buckets)).join(F.broadcast(wanted), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term; one row
    return scored.groupBy("id", "doc").agg(F.sum(F.col("m") * _idf(F.col("n"), F.col("df")) * _saturated(F.col("tf").cast("double"), F.col("len").cast("double"), F.col("mean"))).alias("score")).drop("doc")


def fuzzy(rows: DataFrame, query: str, name: str = "name", threshold: int = 70) -> DataFrame:
    """rows whose name reaches the similarity, with a score of 0 to 1. Names that can't are left out before Python sees them."""
    workers_find_us(rows.sparkSession)
    near = rows.where(fz.letters_allow(query, F.col(name), threshold))
    return near.withColumn("score", fz.similarity(query)(F.col(name)) / 100.0).where(F.col("score") >= threshold / 100.0)


def ranks(rows: DataFrame, rank: str, id: str = "id") -> DataFrame:
    """(id, rank): the place of every row by falling score, ties by id, from 1.

    A list of up to ONE_TASK rows is numbered in one task. A longer one is cut into ranges of the order, numbered range by
    range, and each range begins after the rows of those before it; so no task sees the whole list.
    """
    shelf, order = Shelf(rows.sparkSession), [F.desc("score"), F.asc(id)]
    slim = shelf.keep(rows.select(id, "score"))
    if slim.count() <= ONE_TASK:
        return slim.select(id, F.row_number().over(Window.orderBy(*order)).cast("bigint").alias(rank))
    parts = shelf.keep(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return within.join(F.broadcast(ahead), "part").select(id, (F.col("ahead") + F.col("n")).alias(rank))  # ahead: a row per partition


def fused(first: DataFrame, second: DataFrame, id: str = "id") -> DataFrame:
    """(id, score, match_type) by reciprocal ranks in two scored lists, ties by id; BM25 if in the first, else Fuzzy."""
    both = ranks(first, "r1", id).join(ranks(second, "r2", id), id, "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(float(RRF_K)) + F.col(r)), F.lit(0.0))
    return both.select(id, (part("r1", W_BM25) + part("r2", W_FUZZY)).alias("score"), F.when(F.col("r1").isNotNull(), "BM25").otherwise("Fuzzy").alias("match_type"))


def top(rows: DataFrame, k: int, id: str = "id") -> DataFrame:
    return rows.orderBy(F.desc("score"), F.asc(id)).limit(k)


def symbol_text() -> Column:
    return tx.search_text(F.col("name"), F.col("qualified_name"), F.col("summary"), F.col("keywords"))


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, language: str | None = None, k: int = 20, threshold: int = 70) -> DataFrame:
    """The k best symbols by BM25 and fuzzy names, with score and match_type, of a kind and language."""
    some = narrowed(symbols, kind, language)
    found = fused(bm25(some, query, symbol_text()), fuzzy(some, query, threshold=threshold))
    return top(some.join(F.broadcast(top(found, k)), "id"), k)  # k rows


def search_text(symbols: DataFrame, sources: DataFrame, needle: str, k: int = 20) -> DataFrame:
    """The k symbols whose files have the text most often, case aside; a file is read once for all of its symbols."""
    hits = sources.select("repo_key", "file_path", tx.occurrences(F.col("content"), needle).cast("double").alias("score")).where("score > 0")
    return top(symbols.join(hits, ["repo_key", "file_path"]).withColumn("match_type", F.lit("Exact")), k)
