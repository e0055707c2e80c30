"""Vectorised text kernels over Arrow batches: words, shingle sets and MinHash without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes, which keeps temporaries in cache and memory small; longer texts make a run of their own.
RUN_BYTES = (1 << 19) - 1
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, p, U64)]), dtype=U64) for p in (_P, _INV))
    return _powers[0][:n], _powers[1][:n]


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one array of strings with 64-bit offsets."""
    a = pc.cast(column, pa.large_string())
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large_string array; nulls count as empty."""
    texts = pc.fill_null(texts, "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts whose bytes come to about most."""
    if not len(texts):
        return
    offsets, _ = buffers(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, len(texts))
        start = end


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, start byte, end byte) of each word of a lower-cased run; bytes count from the run's start.

    A word is a longest run of ASCII letters and digits and of bytes beyond ASCII.
    """
    offsets, raw = buffers(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[raw]
    change = np.empty(n + 1, bool)
    change[0], change[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # two texts that touch in the middle of a word
    edges = np.sort(np.concatenate([np.flatnonzero(change), cuts, cuts]))
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    doc = np.searchsorted(offsets, starts, "right") - 1
    return doc, hashes, starts, ends


def shingles(doc: np.ndarray, hashes: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 40-bit hash) of each distinct shingle of size words, sorted; a text of fewer words has one of them all."""
    n = len(doc)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    total = np.zeros(n, U64)
    whole = np.ones(n, bool)
    for k in range(size):
        total *= U64(_P)
        same = np.zeros(n, bool)
        same[: n - k] = doc[k:] == doc[: n - k]
        part = np.zeros(n, U64)
        part[: n - k] = hashes[k:]
        total += np.where(same, part, U64(0))
        whole &= same
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    keep = whole | first
    key = (doc[keep].astype(U64) << U64(40)) | (mix(total[keep]) >> U64(24))
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U64(40)).astype(np.int64), key & U64((1 << 40) - 1)


def per_doc(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that occur in the sorted doc, first index of each)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[at], at


def minhash(elements: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(sets, seeds) of 32-bit minima; at has the first index of each set in elements."""
    low = (mix(elements) >> U64(32)).astype(np.uint32)
    out = np.empty((len(at), len(seeds)), np.uint32)
    for k, (a, b) in enumerate(seeds):
        x = low * a
        x ^= x >> np.uint32(15)
        x *= b
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def hash_seeds(k: int, seed: int) -> np.ndarray:
    """k pairs of odd 32-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 31, (k, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
