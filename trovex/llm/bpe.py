"""Operator 3: BPE encoding and decoding with a contiguous rank array.

A text is split by the vocabulary's pattern. For a short piece, one array holds the part boundaries and beside them the
rank of each part joined with the next; the least rank is looked for again and again, its boundary is deleted and the
two ranks beside it are refreshed. Long pieces, for which that scan is quadratic, keep the same order of merges with a
heap. Decoding gathers the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trovex.llm import kernel as K
from trovex.llm.shared import col

#: Pieces of more bytes go to the heap.
SHORT = 200
#: Bytes of one generation of a worker's cache of encoded pieces; there are two, and the older one goes when the newer is full.
CACHE_BYTES = 8 << 20
#: Bytes of an entry in a dictionary, beside its key and value.
ENTRY = 48
#: Pieces, or tokens, of a text that are worked on at once.
AT_ONCE = 1 << 16
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = 1 << 40


class Bpe:
    """Encoder and decoder of the rank file at path: lines of base64 token and rank."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room = CACHE_BYTES
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def piece(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > SHORT:
            return self.long_piece(word)
        get = ranks.get
        at = list(range(len(word) + 1))
        rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            del at[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(word[at[i] : at[i + 2]], _NONE)
            if i:
                rank[i - 1] = get(word[at[i - 1] : at[i + 1]], _NONE)
        return [ranks[word[a:b]] for a, b in zip(at, at[1:])]

    def long_piece(self, word: bytes) -> list[int]:
        """As piece, in n log n steps."""
        n, get = len(word), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            before[end if end < n else n] = i
            for a in (i, before[i]):
                if a >= 0 and after[a] < n:
                    e = after[after[a]]
                    if (r := get(word[a:e])) is not None:
                        heapq.heappush(heap, (r, a, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian 32-bit integers in a row."""
        if len(text) <= AT_ONCE:
            return self.joined(self.pattern.findall(text))
        return b"".join(self.joined(x) for x in batched((m.group() for m in self.pattern.finditer(text)), AT_ONCE))

    def joined(self, pieces: list[str] | tuple[str, ...]) -> bytes:
        """Token ids of pieces in a row."""
        out = list(map(self.cache.get, pieces))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    p = pieces[i]
                    x = self.cache.get(p)
                    if x is None:
                        x = self.older.get(p)
                        if x is None:
                            ids = self.piece(p.encode())
                            x = struct.pack(f"<{len(ids)}i", *ids)
                        if len(p) < SHORT:
                            self.remember(p, x)
                    out[i] = x
        return b"".join(out)

    def remember(self, piece: str, ids: bytes) -> None:
        """Add to the cache, which never has more than two generations of CACHE_BYTES, however long a text is."""
        size = sys.getsizeof(piece) + sys.getsizeof(ids) + ENTRY
        if size > self.room:
            self.cache, self.older, self.room = {}, self.cache, CACHE_BYTES
        self.cache[piece] = ids
        self.room -= size

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a row of token ids."""
        return b"".join(self.gathered(ids[i : i + AT_ONCE]) for i in range(0, len(ids), AT_ONCE))

    def gathered(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.begins[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


@lru_cache(4)
def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Bpe:
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, tokens, exact) of every row: token ids in order, and whether decoding them gives the text's bytes.

    A null text has null tokens and counts; an empty one has none and is exact. Identifiers may be null or repeat: rows
    are encoded one by one. Other columns are dropped. An empty table gives no rows. path must be readable on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts, ids = K.text_array(batch.column(1)), batch.column(0)
            for a, b in K.runs(texts):
                part = texts.slice(a, b - a)
                offsets, raw = K.buffers(part)
                none = part.is_null().to_numpy(zero_copy_only=False)
                rows = [bpe.encode(t) if t else b"" for t in part.to_pylist()]
                counts = np.array([len(r) // 4 for r in rows], np.int32)
                tokens = np.frombuffer(b"".join(rows), "<i4")
                ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens), mask=pa.array(none))
                back = np.frombuffer(bpe.decode(tokens), np.uint8)
                sizes = np.concatenate([[0], np.cumsum(bpe.lengths[tokens])])[ends]
                exact = np.diff(sizes) == np.diff(offsets)
                if len(back) == len(raw) and exact.all():
                    wrong = np.flatnonzero(back != raw)
                    exact[np.searchsorted(offsets, wrong, "right") - 1] = False
                else:
                    exact = np.array([back[sizes[i] : sizes[i + 1]].tobytes() == raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(b - a)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts, mask=none), lists, pa.array(exact, mask=none)], names=["id", "n_tokens", "tokens", "exact"])

    slim = docs.select(col(docs, id).alias("id"), col(docs, text).cast("string").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens int, tokens array<int>, exact boolean").withColumnRenamed("id", id)


def decode_documents(encoded: DataFrame, id: str = "doc_id", tokens: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(id, text) of rows with a column of token ids; null tokens give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = [None if x.values is None else bpe.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id].dataType.simpleString()
    return encoded.select(col(encoded, id).alias("id"), col(encoded, tokens).alias("tokens")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id)
