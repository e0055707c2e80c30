"""Operator 6: near duplicates by a MinHash containment ensemble.

Documents are sets of word shingles (lower-cased words, punctuation dropped). Sets are partitioned by size into geometric
classes. For sets whose classes are d steps apart, the containment threshold t becomes the Jaccard threshold
t / (ratio + 1 - t) at the largest size ratio of the two classes, and bands and rows are tuned for it alone. Every
candidate is checked on the sets themselves.

MinHash finds partners of up to 1 / t times the size; near copies are never further apart. Beyond that the Jaccard
threshold falls so low that chance collisions outnumber the documents, so there the documents that would stay are looked
up by shingles in all larger sets: the PROBES least shingle hashes of each, rarest first and only as many as a held
set can't do without. Sets of up to PROBES shingles are found without exception, others by a chance stated at _needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovex.llm import kernel as K
from trovex.llm.shared import Shelf, col, components, key_join, numbers

WIDE = "id string, k bigint, len int, h bigint, alt bigint, n int, keys binary, bits binary, probes binary"
#: Buckets of more sets are first linked by the hubs of their size classes alone: fewer pairs to check in groups of near copies. It changes cost, not results.
HUB = 1
#: So often at most are components that meet in buckets linked by a few pairs first, while more pairs of sets are left than FEW_APART. Both change cost, not results.
TURNS, FEW_APART = 3, 100_000
#: Bytes of pairs, with the sets that go with them, that are shuffled at once; more are done in slices, one after another. It changes disk and cost, not results.
SLICE = 1 << 30
#: Bytes of a pair's row in a shuffle, beside what goes with it, and of a shingle's row.
PAIR, HIT = 60, 24
#: Shingles of a set that are looked up in larger ones.
PROBES = 32
#: The filter of shingles that are looked up has so many bits for each, within these bounds (64 MB); a fuller one lets more rows pass and loses none.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 32, 20, 29
#: Bytes of a shingle's hash.
ELEMENT = 5
#: Rows of (probe, set) that are broadcast, 20 bytes each; more are joined by shuffle.
FEW_ASKED = 500_000
#: Pairs of sets that share their hash are told apart through a table of so many rows at most, 16 bytes each; 64-bit hashes of 10**12 sets give about 30,000.
CLASHES = 1_000_000


@dataclass(frozen=True)
class Ensemble:
    """threshold: containment from which a smaller set counts as held by a larger one. step: ratio of neighbouring size
    classes. recall: of a pair at the threshold, by which each banding is tuned within hashes MinHash values.
    hash_bits: of the sets' hashes; fewer than 64 are for tests."""

    shingle: int = 4
    threshold: float = 0.7
    step: float = 1.1
    hashes: int = 128
    recall: float = 0.9
    seed: int = 7
    hash_bits: int = 64
    bandings: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self):
        steps = math.ceil(math.log(self.max_ratio) / math.log(self.step) - 1e-9) + 1
        object.__setattr__(self, "bandings", tuple(self.tuned(d) for d in range(steps)))

    @property
    def max_ratio(self) -> float:
        """Of sizes, up to which MinHash finds partners."""
        return 1 / self.threshold

    def jaccard(self, d: int) -> float:
        """The least Jaccard similarity of a pair at the threshold whose classes are d steps apart."""
        return self.threshold / (min(self.step ** (d + 1), self.max_ratio) + 1 - self.threshold)

    def tuned(self, d: int) -> tuple[int, int]:
        """(bands, rows): the most rows, then the fewest bands, that reach the recall within the hashes. Hashes that reach it with no rows at all raise."""
        j = self.jaccard(d)
        for rows in range(8, 0, -1):
            need = math.ceil(math.log(1 - self.recall) / math.log(1 - j**rows))
            if need * rows <= self.hashes:
                return need, rows
        raise ValueError(f"{self.hashes} hashes don't reach a recall of {self.recall}")

    def tables(self) -> dict[int, int]:
        """Bands by rows, as many as any classes need."""
        out: dict[int, int] = {}
        for bands, rows in self.bandings:
            out[rows] = max(out.get(rows, 0), bands)
        return out


#: Hashes that several sets share, with the least alt of each.
Clashes = tuple[np.ndarray, np.ndarray]
NO_CLASH: Clashes = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array with the bytes of each row of a matrix."""
    return _pieces(np.ascontiguousarray(rows).view(np.uint8).ravel(), np.full(len(rows), rows.shape[1] * rows.itemsize, np.int64))


def _pieces(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary array of pieces of raw, one after another."""
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _shingled(texts: pa.Array, cfg: Ensemble, clashes: Clashes = NO_CLASH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text indices, shingles, first shingle of each, number, hash of the set, alt) for runs of texts, those without words left out.

    alt is a second hash. Where several sets share a hash, all but the one of the least alt have their alt for a hash.
    """
    mask = K.U64((1 << cfg.hash_bits) - 1)
    for a, b in K.runs(texts):
        doc, hashes, _, _ = K.words(pc.utf8_lower(texts.slice(a, b - a)))
        d, elems = K.shingles(doc, hashes, b - a, cfg.shingle)
        docs, at = K.per_doc(d)
        if len(docs):
            n = np.diff(np.append(at, len(elems)))
            h = (K.mix(np.add.reduceat(K.mix(elems + K.U64(1)), at) ^ n.astype(K.U64)) & mask).view(np.int64)
            alt = K.mix(np.add.reduceat(K.mix(elems ^ K.U64(0xA24BAED4963EE407)), at) + n.astype(K.U64)).view(np.int64)
            if len(clashes[0]):
                place = np.searchsorted(clashes[0], h)
                place[place == len(clashes[0])] = 0
                h = np.where((clashes[0][place] == h) & (clashes[1][place] != alt), alt, h)
            yield docs + a, elems, at, n, h, alt


def _once(h: np.ndarray) -> np.ndarray:
    """Indices of the first of each hash, in order."""
    return np.sort(np.unique(h, return_index=True)[1])


def _band_keys(sig: np.ndarray, tables: dict[int, int]) -> np.ndarray:
    """Keys of all bands of all tables, side by side."""
    sig, out = sig.astype(np.uint64), []
    for r, b in tables.items():
        x = np.zeros((len(sig), b), np.uint64)
        for i in range(r):
            x = K.mix(x ^ (sig[:, i : b * r : r] + K.mix(np.full(1, i + 1, np.uint64))))
        out.append(K.mix(x + (np.arange(b, dtype=np.uint64) + K.U64(1000 * r)) * K.U64(0x9E3779B97F4A7C15)))
    return np.concatenate(out, axis=1)


def _least(elems: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """The first PROBES shingles of each set, which are its least hashes and so a sample by chance."""
    size = np.minimum(n, PROBES)
    ends = np.concatenate([[0], np.cumsum(size)])
    picked = elems[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
    return _pieces(_packed(picked), size * ELEMENT)


def _packed(elems: np.ndarray) -> np.ndarray:
    return elems.view(np.uint8).reshape(-1, 8)[:, :ELEMENT]


def _unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // ELEMENT, 8), np.uint8)
    out[:, :ELEMENT] = np.frombuffer(x, np.uint8).reshape(-1, ELEMENT)
    return out.view(np.uint64).ravel()


def _bitmaps(elems: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of each set's shingles: of 64 bits at least, else of two to four bits a shingle, a power of two of them."""
    size = np.maximum(64, 4 << np.floor(np.log2(n)).astype(np.int64))  # bits
    first = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(first[-1], bool)
    bits[np.repeat(first[:-1], n) + (elems & (np.repeat(size, n) - 1).astype(K.U64)).astype(np.int64)] = True
    return _pieces(np.packbits(bits, bitorder="little"), size // 8)


def _sets(cfg: Ensemble):
    seeds, tables = K.hash_seeds(max(b * r for r, b in cfg.tables().items()), cfg.seed), cfg.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ks, lens = batch.column(0), batch.column(1), batch.column(3)
            for docs, elems, at, n, h, alt in _shingled(K.text_array(batch.column(2)), cfg):
                pick = pa.array(docs)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pick), ks.take(pick), lens.take(pick), pa.array(h), pa.array(alt), pa.array(n.astype(np.int32)), _binary(_band_keys(K.minhash(elems, at, seeds), tables)), _bitmaps(elems, at, n), _least(elems, at, n)],
                    names=["id", "k", "len", "h", "alt", "n", "keys", "bits", "probes"],
                )

    return run


def _clashes(wide: DataFrame) -> Clashes:
    """The hashes that several of the sets share; as a rule there are none."""
    found = wide.groupBy("h").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("h", "lo").limit(CLASHES + 1).collect()  # CLASHES rows at most
    if len(found) > CLASHES:
        raise RuntimeError(f"more than {CLASHES} hashes of sets clash")
    h, lo = np.array([r.h for r in found], np.int64), np.array([r.lo for r in found], np.int64)
    order = np.argsort(h)
    return (h[order], lo[order]) if found else NO_CLASH


def _told_apart(wide: DataFrame, clashes: Clashes) -> DataFrame:
    """wide with hashes as _shingled gives them once the clashes are known, without alt."""
    if not len(clashes[0]):
        return wide.drop("alt")
    table = numbers(wide.sparkSession, h=clashes[0], lo=clashes[1])
    joined = wide.join(F.broadcast(table), "h", "left")  # CLASHES rows at most
    return joined.withColumn("h", F.when(F.col("lo") != F.col("alt"), F.col("alt")).otherwise(F.col("h"))).select(*[c for c in wide.columns if c != "alt"])


def _buckets(cfg: Ensemble):
    """A row (key, h, tag) for each band of a set; tag packs the set's size, the band and the banding's rows. Copies within a batch count once."""
    tables = cfg.tables()
    tags = np.concatenate([(np.arange(b, dtype=np.int64) << 4) | r for r, b in tables.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                once = _once(batch.column(0).to_numpy(zero_copy_only=False))
                keys = np.frombuffer(b"".join(batch.column(2).take(pa.array(once)).to_pylist()), np.int64)
                h, n = (batch.column(i).to_numpy(zero_copy_only=False)[once] for i in (0, 1))
                tag = (n.astype(np.int64) << 20)[:, None] | tags
                for a in range(0, len(h), 1000):  # a bounded number of rows at a time
                    b = min(len(h), a + 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a * len(tags) : b * len(tags)]), pa.array(np.repeat(h[a:b], len(tags))), pa.array(tag[a:b].ravel())], names=["key", "h", "tag"])

    return run


def _class(cfg: Ensemble, n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(cfg.step)) + F.lit(1e-9)).cast("int")


def _bucketed(shelf: Shelf, wide: DataFrame, cfg: Ensemble) -> DataFrame:
    """(key, h, n, band, r, step, m, hub) of the sets in buckets of several: m sets, of whose size class the hub is the least."""
    # One shuffle brings each bucket together; buckets of one set are dropped at once.
    index = wide.select("h", "n", "keys").mapInArrow(_buckets(cfg), "key bigint, h bigint, tag bigint").repartition("key").dropDuplicates()
    index = index.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1")
    index = index.select("key", "h", F.shiftright("tag", 20).cast("int").alias("n"), F.shiftright("tag", 4).bitwiseAND(0xFFFF).cast("int").alias("band"), F.col("tag").bitwiseAND(15).cast("int").alias("r"), "m").withColumn("step", _class(cfg, F.col("n")))
    return shelf.keep(index.withColumn("hub", F.when(F.col("m") > HUB, F.min(F.struct("n", "h")).over(Window.partitionBy("key", "step")))))


def _used(cfg: Ensemble, apart: Column, r: Column, band: Column) -> Column:
    """Whether a band belongs to the banding of classes that are so many steps apart."""
    out = F.lit(False)
    for d, (b, rows) in enumerate(cfg.bandings):
        out = out | ((apart == d) & (r == rows) & (band < b))
    return out


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow the overlap of least: a bit of the smaller set that the larger hasn't is a shingle that it hasn't. No pair that reaches it is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        sizes = np.array([(len(x), len(y)) for x, y in zip(left, right)])
        missing = np.zeros(batch.num_rows, np.int64)
        for m, k in np.unique(sizes, axis=0):
            rows = np.flatnonzero((sizes == (m, k)).all(1))
            x = np.frombuffer(b"".join(left[i] for i in rows), np.uint8).reshape(-1, m)
            y = np.frombuffer(b"".join(right[i] for i in rows), np.uint8)
            y = np.bitwise_or.reduce(y.reshape(-1, k // m, m), axis=1) if k >= m else np.tile(y.reshape(-1, k), m // k)
            missing[rows] = np.bitwise_count(x & ~y).sum(1)
        n, least = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)], names=["a", "b", "na", "nb", "least"]).filter(pa.array(n - missing >= least))


def _elements(cfg: Ensemble, clashes: Clashes):
    """(h, sorted shingles of ELEMENT bytes) of texts; copies within a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for docs, elems, at, n, h, _ in _shingled(K.text_array(batch.column(0)), cfg, clashes):
                raw = _packed(elems)
                for i in _once(h):
                    if h[i] not in seen:
                        seen.add(h[i])
                        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 1]), pa.array([raw[at[i] : at[i] + n[i]].tobytes()], pa.binary())], names=["h", "elems"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = []
        for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            x, y = _unpacked(x), _unpacked(y)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(both, pa.int32())], names=["a", "b", "na", "nb", "least", "both"])


def _slices(pairs: DataFrame, total: int, most: int) -> list[DataFrame]:
    """pairs(a, b, ...) of total bytes by chance in parts of about most bytes; a pair is in one part with all its rows."""
    k = math.ceil(total / most)
    return [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(k)) == i) for i in range(k)] if k > 1 else [pairs]


def _in_order(tables: Iterable[DataFrame]) -> tuple:
    """The arguments with which Shelf.keep writes tables one after another."""
    first, *more = tables
    return first, "lz4", *more


class _Run:
    """What the steps of one search share: the texts, their sets, and the tables kept."""

    def __init__(self, shelf: Shelf, rows: DataFrame, sets: DataFrame, one: DataFrame, clashes: Clashes, cfg: Ensemble):
        self.shelf, self.rows, self.sets, self.one, self.clashes, self.cfg = shelf, rows, sets, one, clashes, cfg

    def sliced(self, pairs: DataFrame, width: Column, step: Callable[[DataFrame], DataFrame], beside: Callable[[], int] = lambda: 0) -> DataFrame:
        """step of the kept pairs(a, b, ...), as a table. width: bytes of a pair in step's widest shuffle.

        Pairs of texts that have much in common without being near copies grow as the square of the input, and a set
        goes with each. So pairs of more than SLICE bytes, or than the sets that lie beside them take, are done in slices.
        """
        total = pairs.agg(F.sum(width.cast("long"))).first()[0] or 0
        return self.shelf.keep(*_in_order(map(step, _slices(pairs, total, SLICE if total <= SLICE else max(SLICE, beside())))))

    def checked(self, pairs: DataFrame, silent: DataFrame | None = None) -> DataFrame:
        """exact for candidates (a, b, na, nb), once the pairs that the bitmaps rule out are gone. Sets in silent(a, silent) only look for near copies."""
        pairs = self.shelf.keep(pairs)
        bits = self.one.select("h", "bits")

        def bounded(part: DataFrame) -> DataFrame:
            least = self.needed("na")
            if silent is not None:
                part, least = part.join(silent, "a", "left"), F.when(F.col("silent"), self.needed("nb")).otherwise(least)
            part = part.withColumn("least", least)
            part = part.join(bits.select(F.col("h").alias("a"), F.col("bits").alias("ba")), "a").join(bits.select(F.col("h").alias("b"), F.col("bits").alias("bb")), "b")
            return part.select("a", "b", "na", "nb", "least", "ba", "bb").mapInArrow(_bounded, "a bigint, b bigint, na int, nb int, least int")

        left = self.sliced(pairs, PAIR + F.greatest(F.lit(8), F.col("na") / 2), bounded)
        self.shelf.drop(pairs)
        return self.exact(left)

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Of the kept candidates (a, b, na, nb, least) those with at least so many common shingles: (a, b, na, nb, both). pairs is dropped.

        The sets are made anew from their texts, so that they needn't be kept for all documents. Shingles are compared
        by hashes of 8 * ELEMENT bits, so two sets of n and m have n * m / 2**40 more in common by chance.
        """
        shelf = self.shelf
        needed = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        texts = shelf.keep(self.sets.join(needed, "h", "left_semi").groupBy("h").agg(F.min("k").alias("k")).select("k").distinct())
        elems = key_join(self.rows.select("t", "k"), texts, ["k"], "left_semi").select("t").mapInArrow(_elements(self.cfg, self.clashes), "h bigint, elems binary")
        elems = shelf.keep(elems.groupBy("h").agg(F.first("elems").alias("elems")), "none")

        def counted(part: DataFrame) -> DataFrame:
            joined = part.join(elems.select(F.col("h").alias("a"), F.col("elems").alias("ea")), "a").join(elems.select(F.col("h").alias("b"), F.col("elems").alias("eb")), "b")
            both = joined.select("a", "b", "na", "nb", "least", "ea", "eb").mapInArrow(_overlaps, "a bigint, b bigint, na int, nb int, least int, both int")
            return both.where("both >= least").drop("least")

        out = self.sliced(pairs, PAIR + ELEMENT * F.col("na"), counted, lambda: elems.agg(F.sum(F.octet_length("elems"))).first()[0] or 0)
        shelf.drop(elems, texts, pairs)
        return out

    def alike(self, index: DataFrame) -> DataFrame:
        """Links of sets of up to max_ratio times the size, from the buckets they share; index is dropped.

        Not in it are links within a crowd that is tied together by others, and sets held by, but no near copies of, larger
        ones where their document can't be the one that stays of its crowd.
        """
        shelf, cfg = self.shelf, self.cfg
        # First only each large bucket's hubs are linked with their classes: that ties groups of many copies together in linear time.
        star = index.where("hub is not null and h <> hub.h").where(_used(cfg, F.lit(0), F.col("r"), F.col("band")))
        star = star.select(F.col("hub.h").alias("a"), F.col("h").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct()
        links = self.checked(star)
        label = shelf.keep(components(shelf, self.near(links)))
        labelled, apart = self.unlike(index, label)
        # Crowds that meet in buckets and are near copies would give all pairs of their sets; a few pairs of each bucket join most of them before.
        for turn in range(TURNS):
            if apart <= FEW_APART:
                break
            found = self.checked(self.leaders(labelled, turn))
            links = links.union(found)
            label, (before, was) = shelf.keep(components(shelf, self.near(links))), (labelled, apart)
            labelled, apart = self.unlike(index, label)
            shelf.drop(before)
            if apart > 0.5 * was:
                break
        shelf.drop(index)
        # Then all pairs of a bucket that aren't in one component yet: sets beside its most frequent component, with all others.
        x, y = labelled.where("minor").alias("x"), labelled.alias("y")
        once = ~F.col("y.minor") | (F.col("x.h") < F.col("y.h"))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & once & _used(cfg, F.abs(F.col("x.step") - F.col("y.step")), F.col("x.r"), F.col("x.band")))
        pairs = shelf.keep(*_in_order(_slices(self.ordered(pairs), apart // 2 * PAIR, SLICE)))
        shelf.drop(labelled)
        # What joins two crowds later keeps the lesser of their documents, so only these are looked at for holders.
        silent = self.silent(label, chiefs(self.sets.join(label.withColumnRenamed("node", "h"), "h"))).select(F.col("h").alias("a"), F.lit(True).alias("silent"))
        return links.union(self.checked(pairs, silent))

    def unlike(self, index: DataFrame, label: DataFrame) -> tuple[DataFrame, int]:
        """index with labels, of the buckets with sets of several components, and how many pairs of such sets there are at most; minor: not of the most frequent."""
        out = index.select("key", "h", "n", "band", "r", "step", "m").join(label.withColumnRenamed("node", "h"), "h", "left").withColumn("label", F.coalesce("label", "h"))
        out = out.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
        out = out.withColumn("major", F.max(F.struct("own", "label")).over(Window.partitionBy("key"))).where("major.own < m")
        out = self.shelf.keep(out.select("key", "h", "n", "band", "r", "step", "label", (F.col("label") != F.col("major.label")).alias("minor"), (F.col("m") - F.col("own")).alias("others")))
        return out, out.agg(F.sum("others")).first()[0] or 0

    def leaders(self, labelled: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b, na, nb) of a bucket's components, as many as it has: one set of each by chance, with those of the next in order of size and of the most frequent."""
        cfg = self.cfg
        one = labelled.groupBy("key", "label").agg(F.min_by(F.struct("h", "n", "step", "band", "r", "minor"), F.xxhash64("h", "key", F.lit(turn))).alias("c"), F.count(F.lit(1)).alias("own")).select("key", "label", "c.*", "own")
        by = Window.partitionBy("key")
        one = one.withColumn("next", F.lead(F.struct("h", "n", "step")).over(by.orderBy("n", "h"))).withColumn("main", F.max(F.when(~F.col("minor"), F.struct("h", "n", "step"))).over(by))
        both = one.select("h", "n", "step", "band", "r", F.explode(F.array("next", "main")).alias("o")).where("o.h <> h").where(_used(cfg, F.abs(F.col("step") - F.col("o.step")), F.col("r"), F.col("band")))
        return self.ordered(both.select(F.struct("n", "h").alias("x"), F.struct("o.n", "o.h").alias("y")))

    def ordered(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b, na, nb) of pairs of sets x(n, h) and y(n, h) whose sizes MinHash compares, the smaller first."""
        ends = [F.struct(F.col(f"{s}.n").alias("n"), F.col(f"{s}.h").alias("h")) for s in "xy"]
        pairs = pairs.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).where(F.col("q.n") <= F.lit(self.cfg.max_ratio + 1e-9) * F.col("p.n"))
        return pairs.select(F.col("p.h").alias("a"), F.col("q.h").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()

    def needed(self, n: str) -> Column:
        """Common shingles from which a set of n has the threshold in common."""
        return F.ceil(F.lit(self.cfg.threshold) * F.col(n) - F.lit(1e-9)).cast("int")

    def silent(self, label: DataFrame, chief: DataFrame) -> DataFrame:
        """(h) of the sets of crowds of several that don't belong to the document that would stay."""
        return self.shelf.keep(label.join(chief.select("label", F.col("h").alias("asks")), "label").where("node <> asks").select(F.col("node").alias("h")))

    def near(self, links: DataFrame) -> DataFrame:
        return links.where(F.col("both") >= F.lit(self.cfg.threshold) * F.greatest("na", "nb") - F.lit(1e-9))

    def excerpts(self, silent: DataFrame) -> DataFrame:
        """Links (a, b, na, nb, both) of sets beyond max_ratio: a, which isn't in silent(h), is held by b.

        All texts are read once more. A filter of all probes, of bounded size and broadcast, drops most shingles before
        the shuffle; only then are shingles matched exactly.
        """
        shelf, cfg = self.shelf, self.cfg
        spark = shelf.spark
        probes = shelf.keep(key_join(self.one.select("h", "n", "probes"), silent, ["h"], "left_anti").mapInArrow(_exploded, "e bigint, a bigint, na int, pos int"))
        bits = min(max(FILTER_LEAST, math.ceil(math.log2(FILTER_BITS * max(1, probes.count())))), FILTER_MOST)
        slot = F.explode(F.array(F.col("e"), F.shiftright("e", 11))).alias("s")
        slots = probes.select(slot).select(F.col("s").bitwiseAND((1 << bits) - 1).alias("s"))
        parts = slots.groupBy(F.expr("s div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("bitmap"))
        table = bytearray(1 << bits - 3)
        for r in parts.toLocalIterator():  # 4 KB each, 64 MB in all at most
            table[r.part * 4096 : r.part * 4096 + len(r.bitmap)] = r.bitmap
        words = spark.sparkContext.broadcast(bytes(table))
        hits = shelf.keep(self.rows.select("t").mapInArrow(_hits(cfg, self.clashes, bits, words), "e bigint, h bigint, n int"))
        words.unpersist()
        # Probes in one set alone, their own, are the rarest.
        seen = hits.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        asked = probes.join(seen, "e", "left").withColumn("df", F.coalesce("df", F.lit(1)))
        count, least, all_of = _needed(cfg)
        asked = asked.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("df", "e"))).where(F.col("place") <= count).where("df > 1")
        asked = asked.select("e", "a", "na", least.alias("least"), "df")
        enough = asked.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("need")).where("n >= need").select("a")
        asked = shelf.keep(asked.join(enough, "a", "left_semi"))
        few = lambda df: F.broadcast(df) if df.count() <= FEW_ASKED else df.hint("merge")
        held_by = hits.select("e", F.col("h").alias("b"), F.col("n").alias("nb"))
        meet = held_by.join(few(asked.drop("df")), "e").where(F.col("nb") > F.lit(cfg.max_ratio + 1e-9) * F.col("na"))

        def counted(part: DataFrame) -> DataFrame:
            # One shuffle for both: a copy in another task hits again, and what a pair has in common is counted.
            part = part.repartition("a", "b").distinct().groupBy("a", "b", "na", "least").agg(F.count(F.lit(1)).alias("met"))
            return part.where("met >= least").select("a", "b", "na")

        total = PAIR * (asked.agg(F.sum("df")).first()[0] or 0)
        pairs = shelf.keep(*_in_order(map(counted, _slices(meet, total, SLICE if total <= SLICE else max(SLICE, HIT * hits.count())))))
        # All probes of the sets that are left, counted in their candidates. Both are a row for a set, as a row for each shingle and pair would be many times the pairs.
        sought = shelf.keep(self.one.select(F.col("h").alias("a"), "n", "probes").join(pairs.select("a").distinct(), "a", "left_semi"))
        met_by = key_join(held_by, sought.select("a", "n", "probes").mapInArrow(_exploded, "e bigint, a bigint, na int, pos int").select("e").distinct(), ["e"], "left_semi")
        met_by = shelf.keep(met_by.groupBy("b", "nb").agg(F.collect_set("e").alias("es")))

        def met_of(part: DataFrame) -> DataFrame:
            part = part.join(sought.select("a", "probes"), "a").join(met_by, "b").select("a", "b", "na", "nb", "probes", "es")
            return part.mapInArrow(_met, "a bigint, b bigint, na int, nb int, both int").where(F.col("both") >= all_of)

        met = self.sliced(pairs, PAIR + ELEMENT * F.least("na", F.lit(PROBES)), met_of)
        shelf.drop(probes, hits, asked, pairs, sought, met_by)
        # Where all shingles are probes, their count is the overlap.
        rest = self.exact(shelf.keep(met.where(F.col("na") > PROBES).select("a", "b", "na", "nb", self.needed("na").alias("least"))))
        return met.where(F.col("na") <= PROBES).union(rest)


def _needed(cfg: Ensemble) -> tuple[Column, Column, Column]:
    """(probes, hits, all hits): a set of n shingles that is held at the threshold has so many of its rarest probes in the holder, and so many of all.

    Exact where all n shingles are probes: no more than n less the least overlap can be missing. Of a larger set's PROBES
    a share of 1 - threshold is missing on average, and at the threshold more than are allowed for with a chance below 1 %.
    """
    need = F.ceil(F.lit(cfg.threshold) * F.col("na") - F.lit(1e-9))
    few = F.col("na") <= PROBES
    most = next(x for x in range(PROBES) if _tail(PROBES, 1 - cfg.threshold, x + 1) <= 0.01)
    hits = 2 if most + 2 <= PROBES else 1
    return F.when(few, F.col("na") - need + 1).otherwise(most + hits).cast("int"), F.when(few, 1).otherwise(hits), F.when(few, need).otherwise(max(1, PROBES - most)).cast("int")


def _tail(n: int, p: float, k: int) -> float:
    """The chance of k or more of n."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e, a, na, pos) for each probe of sets."""
    for batch in batches:
        probes = batch.column(2).to_pylist()
        size = np.fromiter((len(x) // ELEMENT for x in probes), np.int64, len(probes))
        h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([pa.array(_unpacked(b"".join(probes)).view(np.int64)), pa.array(np.repeat(h, size)), pa.array(np.repeat(n, size)), pa.array(pos.astype(np.int32))], names=["e", "a", "na", "pos"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a set's probes are among the distinct shingles es of another."""
    for batch in batches:
        probes, es = batch.column(4).to_pylist(), batch.column(5)
        row = np.arange(batch.num_rows, dtype=np.uint64) << K.U64(40)  # shingles have 40 bits
        mine = np.repeat(row, [len(x) // ELEMENT for x in probes]) | _unpacked(b"".join(probes))
        theirs = np.repeat(row, pc.list_value_length(es).to_numpy(zero_copy_only=False)) | es.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        both = np.bincount((mine[np.isin(mine, theirs)] >> K.U64(40)).astype(np.int64), minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(both.astype(np.int32))], names=["a", "b", "na", "nb", "both"])


def _hits(cfg: Ensemble, clashes: Clashes, bits: int, words):
    """(e, h, n) for each shingle of texts that the filter lets pass; copies within a run of texts count once."""
    mask = K.U64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(words.value, np.uint8)
        for batch in batches:
            for docs, elems, at, n, h, _ in _shingled(K.text_array(batch.column(0)), cfg, clashes):
                alone = np.zeros(len(h), bool)
                alone[_once(h)] = True
                ok = np.repeat(alone, n)
                for slot in (elems & mask, (elems >> K.U64(11)) & mask):
                    ok &= (table[slot >> K.U64(3)] >> (slot & K.U64(7)).astype(np.uint8)) & np.uint8(1) == 1
                owner = np.repeat(np.arange(len(at)), n)[ok]
                yield pa.RecordBatch.from_arrays([pa.array(elems[ok].astype(np.int64)), pa.array(h[owner]), pa.array(n[owner].astype(np.int32))], names=["e", "h", "n"])

    return run


def _place(who: str) -> Column:
    """The order of documents: numbers before other identifiers, nulls last, then k and len."""
    c = lambda x: F.col(f"{who}{x}")
    num = c("id").try_cast("decimal(38,0)")
    return F.struct(c("id").isNull().alias("none"), num.isNull().alias("word"), num.alias("num"), c("id").alias("id"), c("k").alias("k"), c("len").alias("len"))


def chiefs(known: DataFrame) -> DataFrame:
    """(label, id, k, len, h, n) of the document that comes first in each crowd of known(label, id, k, len, h, n)."""
    return known.groupBy("label").agg(F.min_by(F.struct("id", "k", "len", "h", "n"), _place("")).alias("c")).select("label", "c.*")


def near_groups(docs: DataFrame, cfg: Ensemble = Ensemble(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document that is in a group, one of which stays: (id, k, len, keep_id, keep_k, keep_len, copies, stays).

    k and len are xxhash64 and bytes of the text, so that rows of one identifier with other texts are told apart.
    Two documents are near copies if their common shingles are at least the threshold of the larger set; the connected
    components of near copies are crowds, and of a crowd the document of the smallest identifier stays (nulls last, then
    k). If that document's set is held by a larger one of another crowd, its crowd joins that one: at the best share, then
    the largest holder, then the smallest identifier that stays. Of crowds joined so, the one that joins none says who
    stays; where they join in a ring, the one whose document has the largest set, then the smallest identifier. Crowds
    that hold one excerpt aren't joined by it. copies: rows of this very id and text.

    Null and empty texts, and texts without a word, have no shingles and are in no group. A text of fewer words than a
    shingle is one shingle. Repeated rows and equal sets are near copies of each other. Texts of any length are compared
    whole. Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    t = col(docs, text).cast("string")
    rows = docs.select(col(docs, id).cast("string").alias("id"), F.xxhash64(t).alias("k"), t.alias("t"), F.octet_length(t).alias("len")).where("t is not null and t <> ''")
    raw = shelf.keep(rows.mapInArrow(_sets(cfg), WIDE))
    clashes = _clashes(raw)
    wide = _told_apart(raw, clashes)
    index = _bucketed(shelf, wide, cfg)
    sets = shelf.keep(wide.select("id", "k", "len", "h", "n"))
    one = shelf.keep(wide.groupBy("h", "n").agg(F.first("bits").alias("bits"), F.first("probes").alias("probes")))
    shelf.drop(raw)
    run = _Run(shelf, rows, sets, one, clashes, cfg)

    links = run.alike(index)
    label = shelf.keep(components(shelf, run.near(links)))
    known = shelf.keep(sets.join(label.withColumnRenamed("node", "h"), "h", "left").withColumn("label", F.coalesce("label", "h")))
    chief = shelf.keep(chiefs(known))
    # Of a crowd of several sets only the one of the document that would stay asks for holders.
    silent = run.silent(label, chief)
    held = links.where(F.col("both") < F.lit(cfg.threshold) * F.greatest("na", "nb") - F.lit(1e-9)).join(silent.withColumnRenamed("h", "a"), "a", "left_anti").union(run.excerpts(silent))
    shelf.drop(one)

    ends = held.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), (F.col("both") / F.col("na")).alias("share"), "nb").where("la <> lb")
    ends = ends.join(chief.select(F.col("label").alias("lb"), _place("").alias("pb")), "lb")
    # Best first is least here.
    up = shelf.keep(ends.groupBy("la").agg(F.min_by("lb", F.struct(-F.col("share"), -F.col("nb"), F.col("pb"))).alias("lb")))
    tree = shelf.keep(components(shelf, up.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("root")))
    heads = tree.join(up.select(F.col("la").alias("label"), F.lit(True).alias("goes")), "label", "left").join(chief, "label")
    head = heads.groupBy("root").agg(F.min_by(F.struct("id", "k", "len"), F.struct(F.coalesce("goes", F.lit(False)), F.when(F.col("goes"), -F.col("n")), _place(""))).alias("keep"))
    keeps = tree.join(head, "root").select("label", "root", "keep")

    docs_of = known.groupBy("label", "id", "k", "len").agg(F.count(F.lit(1)).alias("copies"))
    crowd = known.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("label").union(keeps.select("label")).distinct()
    out = docs_of.join(crowd, "label", "left_semi").join(chief.select("label", F.struct("id", "k", "len").alias("own")), "label").join(keeps.select("label", "keep"), "label", "left").withColumn("keep", F.coalesce("keep", "own"))
    kind = docs.schema[id].dataType
    return out.select(
        F.col("id").cast(kind).alias("id"), "k", "len", F.col("keep.id").cast(kind).alias("keep_id"), F.col("keep.k").alias("keep_k"), F.col("keep.len").alias("keep_len"), "copies",
        (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("k") == F.col("keep.k")) & (F.col("len") == F.col("keep.len"))).alias("stays"),
    )


def drop_near_copies(docs: DataFrame, cfg: Ensemble = Ensemble(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near_groups, all columns kept under their names; documents in no group stay.

    Of repeated rows of the document that stays, one stays. Null identifiers are compared as equal. Null and empty texts
    stay. An empty table stays empty.
    """
    shelf = Shelf(docs.sparkSession)
    groups = shelf.keep(near_groups(docs, cfg, id, text))
    gone = groups.where("not stays").select("id", "k", "len")
    twice = groups.where("stays and copies > 1").select("id", "k", "len")
    names = docs.columns
    t = col(docs, text).cast("string")
    mark = lambda i, k, n: F.xxhash64(i.isNull(), F.coalesce(i.cast("string"), F.lit("")), k, n).alias("seal")
    seal = lambda df: df.select(mark(F.col("id"), F.col("k"), F.col("len")))
    keyed = docs.select(F.struct(*[col(docs, c) for c in names]).alias("row"), mark(col(docs, id), F.xxhash64(t), F.octet_length(t)))
    kept = key_join(keyed, seal(gone), ["seal"], "left_anti")
    n = twice.count()
    if n:
        again = seal(twice)
        single = key_join(kept, again, ["seal"], "left_anti", n)
        from_many = key_join(kept, again, ["seal"], "left_semi", n).groupBy("seal").agg(F.first("row").alias("row"))
        kept = single.select("row").union(from_many.select("row"))
    return kept.select("row.*")
