"""Operator 1: sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; every partition cuts its run of keys into shards. A shard is
data blocks, a sparse index with the last key of each block, a Bloom filter over the keys, and a footer of fixed size
that says where index and filter lie. Keys share prefixes with the key before them, except at restart points, between
which a reader searches by bisection. A shard is held as rows (one per block) whose payloads, joined by offset, are
its bytes; so none is ever in memory as a whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovex.llm.shared import col, fresh

MAGIC = b"TVXSST01"
FOOTER = "<QQQQQQ8s"
#: Keys up to this number are sent to the shards; more are joined.
FEW_KEYS = 100_000
FOOTER_BYTES = struct.calcsize(FOOTER)
ROWS = "shard string, part int, kind string, offset bigint, first_key binary, last_key binary, entries int, payload binary"


@dataclass(frozen=True)
class Layout:
    """block_bytes, shard_bytes: a block or shard is closed when its data reach so much. restart: entries between whole keys. bits: of the Bloom filter, for each key."""

    block_bytes: int = 64 << 10
    shard_bytes: int = 64 << 20
    restart: int = 16
    bits: int = 10


def key_of(id: object) -> bytes:
    """Bytes in the order of identifiers: null, then integers as 8 sign-flipped bytes, or strings as UTF-8."""
    if id is None:
        return b"\x00"
    if isinstance(id, int):
        return b"\x01" + struct.pack(">Q", (id + (1 << 63)) & ((1 << 64) - 1))
    return b"\x02" + (id if isinstance(id, bytes) else str(id).encode())


def id_of(key: bytes) -> object:
    """The identifier of a key."""
    if key[:1] == b"\x01":
        return struct.unpack(">Q", key[1:])[0] - (1 << 63)
    return None if key == b"\x00" else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


class Block:
    """Entries in the order of their keys, with restart points and a checksum."""

    def __init__(self, restart: int):
        self.every, self.parts, self.size, self.restarts, self.n, self.first, self.last = restart, [], 0, [], 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % self.every:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(self.size)
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += [head, value]
        self.size += len(head) + len(value)
        if not self.n:
            self.first = key
        self.n, self.last = self.n + 1, key

    def bytes(self) -> bytes:
        data = b"".join(self.parts) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        return data + struct.pack("<I", zlib.crc32(data))


def entries(block: bytes, start: int = 0, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block from the restart point at start on."""
    (n,) = struct.unpack_from("<I", block, len(block) - 8)
    at, end = start, len(block) - 8 - 4 * n
    while at < end:
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        at += rest
        yield key, block[at : at + size]
        at += size


def find(block: bytes, key: bytes) -> list[bytes]:
    """The values of key in a block, by bisection over its restart points. A damaged block raises."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("the block's checksum is wrong")
    (n,) = struct.unpack_from("<I", block, len(block) - 8)
    restarts = struct.unpack_from(f"<{n}I", block, len(block) - 8 - 4 * n)
    at = bisect_left(restarts, key, key=lambda r: next(entries(block, r))[0]) - 1  # the last one before key, as equal keys may start ahead of a restart point
    out = []
    for k, v in entries(block, restarts[max(at, 0)] if n else 0):
        if k > key:
            break
        if k == key:
            out.append(v)
    return out


class Bloom:
    """Bits set by double hashing; n keys with so many bits each."""

    def __init__(self, hashes: list[tuple[int, int]], bits: int):
        self.m = max(64, len(hashes) * bits)
        self.k = max(1, round(bits * 0.69))
        self.data = bytearray((self.m + 7) // 8)
        for a, b in hashes:
            for i in range(self.k):
                x = (a + i * b) % self.m
                self.data[x >> 3] |= 1 << (x & 7)

    def bytes(self) -> bytes:
        return struct.pack("<QI", self.m, self.k) + bytes(self.data)

    @staticmethod
    def hash(key: bytes) -> tuple[int, int]:
        a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
        return a, b | 1

    @staticmethod
    def may_have(data: bytes, key: bytes) -> bool:
        m, k = struct.unpack_from("<QI", data)
        a, b = Bloom.hash(key)
        return all(data[12 + (x >> 3)] >> (x & 7) & 1 for x in ((a + i * b) % m for i in range(k)))


class Shard:
    """A reader of one shard's bytes."""

    def __init__(self, data: bytes):
        self.data = data
        i, n, b, m, self.entries, _, magic = struct.unpack(FOOTER, data[-FOOTER_BYTES:])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = data[b : b + m]
        self.index = [(k, *struct.unpack("<QQ", v)) for k, v in entries(data[i : i + n])]

    def get(self, id: object) -> list[bytes]:
        """The values of an identifier; none if it isn't there."""
        key = key_of(id)
        if not Bloom.may_have(self.bloom, key):
            return []
        out = []
        for last, offset, size in self.index[bisect_left(self.index, key, key=lambda x: x[0]) :]:
            out += find(self.data[offset : offset + size], key)
            if last > key:
                break
        return out


def _writer(cfg: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, out = TaskContext.get().partitionId(), 0, []
        index, hashes, offset, block = Block(1), [], 0, Block(cfg.restart)
        first = last = b""

        def row(part: int, kind: str, payload: bytes, a: bytes, b: bytes, n: int) -> None:
            nonlocal offset
            out.append((f"{number:06d}-{shard:06d}", part, kind, offset, a, b, n, payload))
            offset += len(payload)

        def close_block() -> None:
            nonlocal block
            if block.n:
                data = block.bytes()
                where = struct.pack("<QQ", offset, len(data))
                row(index.n, "data", data, block.first, block.last, block.n)
                index.add(block.last, where)
                block = Block(cfg.restart)

        def close_shard() -> None:
            nonlocal index, hashes, offset, shard
            close_block()
            if not index.n:
                return
            n, data, bloom = len(hashes), index.bytes(), Bloom(hashes, cfg.bits).bytes()
            at = offset
            row(index.n, "index", data, first, last, n)
            row(index.n + 1, "bloom", bloom, first, last, n)
            row(index.n + 2, "footer", struct.pack(FOOTER, at, len(data), at + len(data), len(bloom), n, index.n, MAGIC), first, last, n)
            index, hashes, offset, shard = Block(1), [], 0, shard + 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["shard", "part", "kind", "offset", "first_key", "last_key", "entries", "payload"])
            out.clear()
            return done

        for batch in batches:
            values = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                key = key_of(batch.column(0)[i].as_py())
                if not hashes:
                    first = key
                if not hashes or key != last:
                    fingerprint = Bloom.hash(key)
                hashes.append(fingerprint)
                last = key
                block.add(key, values[i].as_py())
                if block.size >= cfg.block_bytes:
                    close_block()
                    if offset >= cfg.shard_bytes:
                        close_shard()
                    if len(out) >= 64:
                        yield flush()
        close_shard()
        if out:
            yield flush()

    return run


def sorted_shards(docs: DataFrame, id: str = "doc_id", cfg: Layout = Layout()) -> DataFrame:
    """Rows of shards: (shard, part, kind, offset, first_key, last_key, entries, payload), kind one of data, index, bloom, footer.

    The value of a key is the JSON object of the row's other columns, nulls included. Integer and string identifiers
    keep their order; other kinds are taken as strings. Rows without an identifier are stored under the null key, which
    is first; rows that repeat an identifier are all stored, in the order of their values. Values may be of any length: a
    longer one than a block makes a block of its own. An empty table gives no rows.
    """
    key, value = fresh(docs, "key", "value")
    kind = docs.schema[id].dataType
    as_key = col(docs, id).cast("bigint") if isinstance(kind, T.IntegralType) else col(docs, id).cast("string")
    rest = [col(docs, c) for c in docs.columns if c != id]
    json = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    pairs = docs.select(as_key.alias(key), json.alias(value))
    return pairs.repartitionByRange(F.col(key)).sortWithinPartitions(key, value).mapInArrow(_writer(cfg), ROWS)


def shard_bytes(rows: DataFrame, shard: str) -> bytes:
    """One shard's bytes, put together on the driver."""
    return b"".join(bytes(r.payload) for r in rows.where(F.col("shard") == shard).orderBy("offset").select("payload").collect())


def _as_keys(keys: DataFrame, id: str) -> DataFrame:
    """(key) of the distinct identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in batch.column(0).to_pylist()], pa.binary())], names=["key"])

    return keys.select(col(keys, id).alias("id")).distinct().mapInArrow(run, "key binary")


def located(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(shard, offset, keys): the data blocks that may hold one of wanted(key), at most FEW_KEYS of them, with those keys.

    A shard's key range and Bloom filter decide whether its index is read, and the sparse index which of its blocks.
    """
    sought = rows.sparkSession.sparkContext.broadcast(sorted(bytes(r.key) for r in wanted.collect()))

    def blooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, found = [], []
            for shard, a, b, bloom in zip(*(batch.column(i).to_pylist() for i in range(4))):
                keys = [k for k in sought.value[bisect_left(sought.value, a) : bisect_right(sought.value, b)] if Bloom.may_have(bloom, k)]
                if keys:
                    shards.append(shard)
                    found.append(keys)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(found, pa.list_(pa.binary()))], names=["shard", "keys"])

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, list[bytes]]] = []
            for shard, index, keys in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lasts, places = zip(*((k, struct.unpack("<QQ", v)[0]) for k, v in entries(index)))
                at: dict[int, list[bytes]] = {}
                for k in keys:
                    for i in range(bisect_left(lasts, k), len(lasts)):
                        at.setdefault(places[i], []).append(k)
                        if lasts[i] > k:  # equal keys may go on in the next block
                            break
                out += [(shard, offset, found) for offset, found in at.items()]
            shards, offsets, found = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["shard", "offset", "keys"])

    asked = rows.where("kind = 'bloom'").select("shard", "first_key", "last_key", "payload").mapInArrow(blooms, "shard string, keys array<binary>")
    index = rows.where("kind = 'index'").select("shard", "payload").join(asked, "shard")
    return index.select("shard", "payload", "keys").mapInArrow(indexes, "shard string, offset bigint, keys array<binary>")


def lookup(rows: DataFrame, keys: DataFrame, id: str = "doc_id") -> DataFrame:
    """(key, value) of every row stored under one of the identifiers in keys; those not there give nothing, a null one the rows without an identifier.

    For up to FEW_KEYS keys only the blocks that located names are opened; more are joined with all entries.
    """
    wanted = _as_keys(keys, id)
    pairs = lambda found: pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v.decode() for _, v in found], pa.string())], names=["key", "value"])
    data = rows.where("kind = 'data'")
    if wanted.count() <= FEW_KEYS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pairs([(k, v) for block, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k in some for v in find(block, k)])

        opened = data.join(F.broadcast(located(rows, wanted)), ["shard", "offset"])  # two rows a key at most, but for repeated keys
        return opened.select("payload", "keys").mapInArrow(run, "key binary, value string")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield pairs(list(entries(block)))

    return data.select("payload").mapInArrow(every, "key binary, value string").join(wanted, "key", "left_semi")
