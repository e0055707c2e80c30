"""Operator 4: exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, each range is sorted externally so that equals are neighbours,
and neighbours are compared in full. The splitters are taken on a short sort key (first characters, length, hash) that
equal texts share, so that the driver's sample stays small and texts with a common opening don't share one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovex.llm.shared import col, fresh

#: Characters of the normalised text in the splitters' key.
OPENING = 48


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\r\\f]+", " "))


def content_sorted(docs: DataFrame, id: str = "doc_id", text: str = "text", partitions: int | None = None) -> tuple[DataFrame, str]:
    """(the rows of docs that have a text, with the place of each among its equals, that column's name): 1 for the smallest identifier.

    Rows with equal normalised text are equal; nulls come last among identifiers, and equal identifiers in any order
    (such rows agree in identifier and normalised text).
    """
    norm, head, size, seal, place = fresh(docs, "norm", "head", "size", "seal", "place")
    keyed = docs.where(col(docs, text).isNotNull())
    keyed = keyed.withColumn(norm, normalised(col(keyed, text).cast("string")))
    keyed = keyed.withColumns({head: F.left(F.col(norm), F.lit(OPENING)), size: F.octet_length(norm), seal: F.xxhash64(norm)})
    keys = [head, size, seal]
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    among = Window.partitionBy(*keys, norm).orderBy(col(ranged, id).asc_nulls_last())
    return ranged.withColumn(place, F.row_number().over(among)).drop(norm, *keys), place


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """docs with one row of each normalised text: that of the smallest identifier. All columns are kept.

    Null texts are all kept; empty texts, and texts of white space alone, equal each other. Null identifiers sort last.
    Of repeated rows one is kept. An empty table stays empty.
    """
    placed, place = content_sorted(docs, id, text, partitions)
    return placed.where(F.col(place) == 1).drop(place).union(docs.where(col(docs, text).isNull()))


SQL = r"""
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS place
  FROM (SELECT *, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS norm FROM documents))
WHERE place = 1 OR text IS NULL
"""
