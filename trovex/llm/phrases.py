"""Operator 5: document fingerprints by locally consistent parsing.

At every level a run of equal names becomes one name. Deterministic coin tossing then shrinks names to labels: a label
is twice the place of the lowest bit in which a name differs from the one before it, plus that bit; after four rounds
six labels are left, of which the upper three are replaced by the least of 0, 1 and 2 that neither neighbour has. Local
maxima, and local minima that have no maximum beside them, begin phrases of two or three names, and the names of the next
level are hashes of phrases. Where a phrase begins depends on a few names around it alone, so equal substrings have equal
phrases except near their ends, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trovex.llm import kernel as K
from trovex.llm.shared import col

U64 = K.U64
#: Least of 0, 1, 2 that is neither left nor right; at left * 8 + right, 7 for none.
_LEAST = np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)
#: Place of the lowest bit set.
_LOWEST = np.array([(x & -x).bit_length() - 1 if x else 0 for x in range(256)], np.uint8)


@dataclass(frozen=True)
class Parsing:
    """levels: of phrases; those of the last are the fingerprint. A phrase has 2.4 names of the level below on average."""

    levels: int = 5
    seed: int = 5


def _toss_small(lab: np.ndarray, head: np.ndarray) -> np.ndarray:
    before = np.empty_like(lab)
    before[1:] = lab[:-1]
    before[head] = lab[head] ^ np.uint8(1)
    place = _LOWEST[lab ^ before]
    return (place << np.uint8(1)) | ((lab >> place) & np.uint8(1))


def _toss(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[head] = names[head] ^ U64(1)
    d = names ^ before
    place = np.bitwise_count((d & (~d + U64(1))) - U64(1)).astype(np.uint8)
    place &= np.uint8(63)
    return (place << np.uint8(1)) | ((names >> place.astype(U64)) & U64(1)).astype(np.uint8)


def _level(names: np.ndarray, head: np.ndarray, starts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, indices of the texts' first names, first bytes) of the phrases over names that begin at the bytes starts."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[head] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(names)))
    names, starts = names[at].astype(U64), starts[at]
    many = size > 1
    names[many] = K.mix(names[many] * U64(0x9E3779B97F4A7C15) + size[many].astype(U64))
    head = np.searchsorted(at, head)

    lab = _toss(names, head)
    for _ in range(3):
        lab = _toss_small(lab, head)
    n = len(lab)
    tail = np.append(head[1:], n) - 1
    for c in (5, 4, 3):
        left, right = np.full(n, 7, np.uint8), np.full(n, 7, np.uint8)
        left[1:], right[:-1] = lab[:-1], lab[1:]
        left[head], right[tail] = 7, 7
        at = np.flatnonzero(lab == c)
        lab[at] = _LEAST[left[at] * np.uint8(8) + right[at]]
    lab = lab.astype(np.int8)
    left, right = np.full(n, 3, np.int8), np.full(n, 3, np.int8)  # beyond a text's ends all is higher: no maximum there
    left[1:], right[:-1] = lab[:-1], lab[1:]
    left[head], right[tail] = 3, 3
    top = (lab > left) & (lab > right)
    beside = np.zeros(n, bool)
    beside[1:] = top[:-1]
    beside[:-1] |= top[1:]
    begin = top | ((lab < left) & (lab < right) & ~beside)
    begin[head] = True
    first = np.flatnonzero(begin)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    part = K.mix(names + (place.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F) + U64(salt))
    return K.mix(np.add.reduceat(part, first)), np.searchsorted(first, head), starts[first]


def parse(offsets: np.ndarray, raw: np.ndarray, cfg: Parsing = Parsing()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first bytes in raw, number for each text) of the last level's phrases of the texts at offsets."""
    some = np.flatnonzero(np.diff(offsets))
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(some):
        return np.zeros(0, U64), np.zeros(0, np.int64), counts
    names, head, starts = raw, offsets[:-1][some], np.arange(len(raw))
    for level in range(cfg.levels):
        names, head, starts = _level(names, head, starts, cfg.seed * 1000 + level)
    counts[some] = np.diff(np.append(head, len(names)))
    return names, starts, counts


def fingerprints(docs: DataFrame, cfg: Parsing = Parsing(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_phrases, phrases, starts) of every row: the last level's phrase names in order, and the byte at which each begins.

    A null text has nulls; an empty one has no phrase; a text of one byte has one. Identifiers may be null or repeat:
    rows are parsed one by one, equal texts alike. Other columns are dropped. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = K.text_array(batch.column(1)), batch.column(0)
            for a, b in K.runs(texts):
                part = texts.slice(a, b - a)
                offsets, raw = K.buffers(part)
                none = part.is_null().to_numpy(zero_copy_only=False)
                names, starts, counts = parse(offsets, raw, cfg)
                starts = starts - np.repeat(offsets[:-1], counts)
                ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x), mask=pa.array(none)) for x in (names.view(np.int64), starts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts.astype(np.int32), mask=none), *lists], names=["id", "n_phrases", "phrases", "starts"])

    slim = docs.select(col(docs, id).alias("id"), col(docs, text).cast("string").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_phrases int, phrases array<bigint>, starts array<int>").withColumnRenamed("id", id)
