"""Operator 8: quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its whole text. The weights are learnt from preference pairs
(a document labelled good over one labelled bad) by logistic loss on the difference of their features. Documents are
rejected below a quantile of scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovex.llm import kernel as K
from trovex.llm.shared import Shelf, col, fresh, key_join

FEATURES = ("upper", "digit", "space", "stop", "other", "repeat", "distinct", "word_bytes", "long_words", "lines", "words")

_CLASS = np.full(256, 4, np.uint8)
_CLASS[range(65, 91)] = 0
_CLASS[range(48, 58)] = 1
_CLASS[[9, 10, 13, 32]] = 2
_CLASS[[ord(c) for c in ".,;:'\"?-"]] = 3
_CLASS[[*range(97, 123), *range(128, 256)]] = 5


@dataclass(frozen=True)
class Ranker:
    """train_docs: most labelled documents that the weights are fitted on, drawn by a hash of the identifier.
    pairs: preference pairs drawn from them. reject_share: of the documents labelled good, the share with the lowest
    scores; the score below which that share lies is the threshold."""

    train_docs: int = 20_000
    pairs: int = 100_000
    steps: int = 300
    rate: float = 0.5
    ridge: float = 1e-3
    reject_share: float = 0.003
    seed: int = 11


def features(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES); an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in K.runs(texts):
        part = texts.slice(a, b - a)
        offsets, raw = K.buffers(part)
        size = np.diff(offsets).astype(float)
        full = np.flatnonzero(size > 0)
        if not len(full):
            continue
        at = offsets[:-1][full]
        kind = _CLASS[raw]
        f = np.zeros((b - a, len(FEATURES)))
        n = size[full]
        for k in range(5):
            f[full, k] = np.add.reduceat((kind == k).astype(np.int32), at) / n
        f[full, 9] = np.add.reduceat((raw == 10).astype(np.int32), at) / n
        doc, hashes, starts, ends = K.words(part)
        docs, first = K.per_doc(doc)
        if len(docs):
            count = np.diff(np.append(first, len(doc))).astype(float)
            again = np.zeros(len(doc))
            again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
            f[docs, 5] = np.add.reduceat(again, first) / count
            keys = np.sort((doc.astype(np.uint64) << K.U64(40)) | (hashes >> K.U64(24)))
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            distinct = np.bincount((keys[new] >> K.U64(40)).astype(np.int64), minlength=b - a)[docs]
            # Of words, the distinct ones follow a power of their number; the exponent hardly depends on length.
            f[docs, 6] = np.log1p(distinct) / np.log1p(count)
            f[docs, 7] = np.add.reduceat((ends - starts).astype(float), first) / count / 10
            f[docs, 8] = np.add.reduceat((ends - starts > 12).astype(float), first) / count
            f[docs, 10] = np.log1p(count) / 10
        out[a:b] = f
    return out


def fit(good: np.ndarray, bad: np.ndarray, cfg: Ranker = Ranker()) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w (x - y))) over drawn pairs of a good x and a bad y, with a ridge. Zeros if either is empty."""
    if not len(good) or not len(bad):
        return np.zeros(len(FEATURES))
    both = np.concatenate([good, bad])
    scale = np.where(both.std(0) > 1e-9, both.std(0), np.inf)
    rng = np.random.default_rng(cfg.seed)
    diff = (good[rng.integers(0, len(good), cfg.pairs)] - bad[rng.integers(0, len(bad), cfg.pairs)]) / scale
    w = np.zeros(diff.shape[1])
    m = v = np.zeros_like(w)
    for t in range(1, cfg.steps + 1):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        g = -(diff * p[:, None]).mean(0) + cfg.ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - cfg.rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w / scale


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(K.text_array(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["good", "place", "x"])


def train(docs: DataFrame, labels: DataFrame, cfg: Ranker = Ranker(), id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights from at most cfg.train_docs labelled documents: label 1 is preferred to label 0, other labels count for nothing.

    An identifier with both labels is on both sides, and all rows of a repeated identifier are looked at; if rows beyond the
    bound come together so, those first by a hash of identifier and text are taken. Zeros if one side is missing.
    """
    drawn = labels.select(col(labels, id).alias("id"), (col(labels, label) == 1).alias("good")).where(col(labels, label).isin(0, 1) & F.col("id").isNotNull())
    drawn = drawn.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(cfg.seed)), "id", "good").limit(cfg.train_docs)
    rows = docs.select(col(docs, id).alias("id"), col(docs, text).cast("string").alias("t")).join(F.broadcast(drawn), "id")  # at most train_docs rows
    rows = rows.select("good", "t", F.xxhash64(F.col("id").cast("string"), "t", F.lit(cfg.seed)).alias("place"))
    found = rows.mapInArrow(_featured, "good boolean, place bigint, x array<double>").orderBy("place", "good").limit(cfg.train_docs).toPandas()
    x = lambda side: np.array(found.x[found.good == side].tolist()).reshape(-1, len(FEATURES))
    good, bad = (y[np.lexsort(y.T)] for y in (x(True), x(False)))  # in an order of their own, whatever Spark's
    return fit(good, bad, cfg)


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> tuple[DataFrame, str]:
    """(docs with a column of scores rounded to 4 digits, its name). A null text has a null score, an empty one 0."""
    (score,) = fresh(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.text_array(batch.column(batch.schema.names.index(text)))
            s = np.round(features(texts) @ weights, 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, mask=texts.is_null().to_numpy(zero_copy_only=False))], names=[*batch.schema.names, score])

    kinds = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, kinds), score


def threshold(scores: DataFrame, labels: DataFrame, score: str, cfg: Ranker = Ranker(), id: str = "doc_id", label: str = "quality") -> float | None:
    """The cfg.reject_share quantile of the scores of all documents labelled good, cut to thousandths; None if there are none."""
    good = labels.select(col(labels, id).alias("id")).where((col(labels, label) == 1) & F.col("id").isNotNull()).distinct()
    bins = scores.select(col(scores, id).alias("id"), F.floor(col(scores, score) * 1000).alias("bin")).join(good, "id").where("bin is not null").groupBy("bin").count().orderBy("bin").collect()  # a row for each thousandth that occurs
    below, total = 0, sum(r["count"] for r in bins)
    for r in bins:
        below += r["count"]
        if below > cfg.reject_share * total:
            return r["bin"] / 1000
    return None


def quality_scores(docs: DataFrame, labels: DataFrame, cfg: Ranker = Ranker(), id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, score, keep) of every row of docs. keep is false below the threshold and for null and empty texts.

    Without good or without bad labels all scores are 0 and every non-empty text is kept. Identifiers may repeat or be
    null: each row is judged by its own text. Equal texts have equal scores. Texts of any length are scored whole; other
    columns are dropped, whatever their names. An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    weights = train(docs, labels, cfg, id, text, label)
    slim = docs.select(col(docs, id).alias(id), col(docs, text).cast("string").alias(text))
    out, score = scored(slim, weights, text)
    out = shelf.keep(out.select(col(out, id), F.col(score).alias("score"), (F.octet_length(col(out, text)) > 0).alias("some")))
    low = threshold(out, labels, "score", cfg, id, label)
    return out.select(id, "score", F.coalesce(F.col("some") & (F.col("score") >= F.lit(-1e300 if low is None else low)), F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, cfg: Ranker = Ranker(), id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of docs that quality_scores keeps, all columns as they were, whatever their names. Texts of any length are scored whole; an empty table stays empty."""
    weights = train(docs, labels, cfg, id, text, label)
    good = labels.select(col(labels, id).alias(id)).where(col(labels, label) == 1).distinct()
    slim = docs.select(col(docs, id).alias(id), col(docs, text).cast("string").alias(text))
    out, score = scored(key_join(slim, good, [id], "left_semi"), weights, text)  # the threshold asks for no others
    low = threshold(out, labels, score, cfg, id, label)
    names = docs.columns
    (t,) = fresh(docs, "t")
    out, score = scored(docs.withColumn(t, col(docs, text).cast("string")), weights, t)
    return out.where((F.octet_length(t) > 0) & (F.col(score) >= F.lit(-1e300 if low is None else low))).select(*[col(out, c) for c in names])
