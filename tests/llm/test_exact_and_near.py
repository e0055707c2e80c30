import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import LONG, ROWS, SAME
from tests.oracle import connect, same
from trovex.llm import exact_dedup, kernel, near_dedup, queries, shared
from trovex.llm.shared import Shelf, components


def test_exact_as_duckdb(spark, sf):
    assert same(spark, connect(sf), queries.QUERIES["op4_exact_dedup"], queries.SQL["op4_exact_dedup"], sf) > 0


def test_exact_on_messy_rows(messy, none):
    for parts in (None, 1, 5):
        out = exact_dedup.exact_dedup(messy, partitions=parts)
        assert out.columns == messy.columns
        got = [(r.doc_id, None if r.text is None else brute.normal(r.text)) for r in out.collect()]
        assert Counter(got) == Counter(brute.exact_kept([(i, t) for i, t, *_ in ROWS]))
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.exact_dedup(none).columns == none.columns


def test_exact_needs_equal_openings_and_more(spark):
    opening = "same opening " * 30
    rows = [(n, f"{opening}{n // 3}") for n in range(300)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), partitions=7)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 300, 3))


def test_exact_plan_has_one_exchange(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def pairs(groups):
    return {(a, b) for ids in groups for a in ids for b in ids if a < b}


def grouped(rows):
    """Groups of (id, keep_id) rows."""
    out = {}
    for i, keep in rows:
        out.setdefault(keep, {keep}).add(i)
    return list(out.values())


def test_near_query_against_all_pairs(spark):
    """1,000 documents of all sizes; the brute force knows no classes and no ratio."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.near_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = grouped((r.doc_id, r.keep_id) for r in queries.op6_near_dedup(spark, sf).collect())
    found, all_pairs = pairs(got), pairs(ids for _, ids in want)
    assert len(all_pairs) > 50
    assert len(found & all_pairs) >= 0.9 * len(all_pairs)
    assert found <= all_pairs


def crowd_rows():
    """Crowds of near copies whose openings overlap, copies, excerpts and strangers."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(6):
        base = common + [f"g{g}w{i}" for i in range(90)]
        for v in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(60, len(words))] = f"v{g}x{v}x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[70:110])))
    rows += [(len(rows) + i, rows[i * 7][1]) for i in range(10)]
    return rows + [(1000 + i, " ".join(f"s{i}w{k}" for k in range(50))) for i in range(30)]


@pytest.mark.parametrize("hub, driver", [(1, 0), (10**6, 100_000)])
def test_groups_do_not_depend_on_hubs(spark, monkeypatch, hub, driver):
    monkeypatch.setattr(near_dedup, "HUB", hub)
    monkeypatch.setattr(shared, "DRIVER_EDGES", driver)
    rows = crowd_rows()
    got = grouped((r.id, r.keep_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sorted(map(sorted, got)) == sorted(ids for _, ids in brute.near_groups(rows))


@pytest.mark.parametrize("asked", [0])
def test_sets_of_one_hash_are_told_apart(spark, monkeypatch, asked):
    monkeypatch.setattr(near_dedup, "FEW_ASKED", asked)
    rows = crowd_rows()
    cfg = near_dedup.Ensemble(hash_bits=6)
    got = grouped((r.id, r.keep_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), cfg).collect())
    assert sorted(map(sorted, got)) == sorted(ids for _, ids in brute.near_groups(rows))


def test_no_pair_is_lost_by_bitmaps():
    rng = np.random.default_rng(1)
    for n, m, share in ((3, 5, 0.8), (40, 41, 0.7), (100, 140, 0.71), (3000, 4200, 0.7)):
        b = np.sort(rng.choice(1 << 40, m, replace=False).astype(np.uint64))
        kept = math.ceil(share * n)
        a = np.sort(np.concatenate([rng.choice(b, kept, replace=False), rng.choice(1 << 40, n - kept, replace=False).astype(np.uint64)]))
        maps = [near_dedup._bitmaps(x, np.array([0]), np.array([len(x)])) for x in (a, b)]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([n], pa.int32()), pa.array([m], pa.int32()), pa.array([kept], pa.int32()), *maps], names=list("abcdefg"))
        assert next(iter(near_dedup._bounded([batch]))).num_rows == 1


def test_who_stays_is_held_by_none_outside(spark):
    """a stays in its crowd though its copy is larger than b, which holds a: so b's group takes it."""
    w = [f"u{i}" for i in range(103)]
    rows = [(1, " ".join(w)), (2, " ".join(w + [f"long{i}" for i in range(40)])), (3, " ".join([f"own{i}" for i in range(48)] + w[10:]))]
    sizes = [len(brute.shingles(t)) for _, t in rows]
    assert sizes[0] < sizes[2] < sizes[1]
    got = {r.id: r.keep_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: keep for keep, ids in brute.near_groups(rows) for i in ids}
    assert got == want and len(set(got.values())) == 1


def test_near_sets_as_in_python(docs):
    texts = [r.text for r in docs.select("text").collect()]
    found = {}
    for at, _, _, n, _, _ in near_dedup._shingled(kernel.text_array(pa.array(texts)), near_dedup.Ensemble()):
        for d, size in zip(at, n):
            found[int(d)] = int(size)
    assert found == {i: len(s) for i, t in enumerate(texts) if (s := brute.shingles(t))}


def test_bandings_reach_the_recall():
    cfg = near_dedup.Ensemble()
    for d, (bands, rows) in enumerate(cfg.bandings):
        assert bands * rows <= cfg.hashes
        assert 1 - (1 - cfg.jaccard(d) ** rows) ** bands >= cfg.recall - 1e-9
    assert len(set(cfg.bandings)) >= 3 and cfg.step ** (len(cfg.bandings) - 1) >= cfg.max_ratio


@pytest.mark.parametrize("words", [12, 60])
def test_near_copies_of_any_length(spark, words):
    base = [[f"w{(i * 7919 + k * 104729) % 100003}" for k in range(words)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(w[:-1] + ["changed"])) for i, w in enumerate(base[:30])]  # one word of all
    rows += [(200 + i, " ".join(w).upper().replace(" ", ", ")) for i, w in enumerate(base[:10])]  # equal sets
    out = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    left = {r.doc_id for r in out.collect()}
    want = {i for i, _ in rows} - {b for _, ids in brute.near_groups(rows) for b in ids if b != min(ids)}
    assert set(range(40)) <= left
    assert len(left - want) <= 0.1 * (len(rows) - len(want)) and want <= left


def test_contained_text_goes_with_the_larger(spark):
    w = [f"u{i}" for i in range(300)]
    rows = [(1, " ".join(w[:180])), (2, " ".join(w)), (3, " ".join(w[:60])), (5, " ".join(w[40:55])), (4, "something else entirely is said in this one text")]
    got = {r.id: r.keep_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 5: 2}


def test_excerpts_of_any_size_go_with_their_holders(spark):
    w = [[f"e{i}x{k}" for k in range(600)] for i in range(20)]
    rows = [(1000 + i, " ".join(x)) for i, x in enumerate(w)]
    rows += [(n, " ".join(w[i][40 : 40 + size])) for n, (i, size) in enumerate((i, size) for i in range(20) for size in (4, 9, 19, 20, 60, 250))]
    # Of 16 and of 54 shingles about a fifth are foreign, of the last ones half.
    rows += [(200 + i, " ".join(x[100:116] + ["own", "words", "here"])) for i, x in enumerate(w)]
    rows += [(300 + i, " ".join(x[100:150] + [f"own{k}" for k in range(7)])) for i, x in enumerate(w)]
    rows += [(400 + i, " ".join(x[100:111] + [f"far{i}x{k}" for k in range(8)])) for i, x in enumerate(w)]
    got = grouped((r.id, r.keep_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    found, all_pairs = pairs(got), pairs(ids for _, ids in brute.near_groups(rows))
    short = {i for i, t in rows if len(t.split()) <= near_dedup.PROBES + 3}
    assert found <= all_pairs and len(found) >= 0.9 * len(all_pairs)
    assert {p for p in found if p[1] >= 1000 and p[0] in short} == {p for p in all_pairs if p[1] >= 1000 and p[0] in short}
    assert not any(400 <= i < 500 for ids in got for i in ids)


def test_query_and_pipeline_take_excerpts(spark, tmp_path):
    w = [f"y{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[30:90])), (3, " ".join(w[50:56]))], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.keep_id) for r in queries.op6_near_dedup(spark, str(tmp_path)).collect()} == {(2, 1), (3, 1)}
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()] == [1]


@pytest.mark.parametrize("turns", [0, 3])
def test_crowds_that_meet_are_linked_by_a_few_pairs(spark, monkeypatch, turns):
    """Two crowds of near copies, of two size classes: one link joins them, so not all pairs of their sets are compared. Without turns all are, to the same result."""
    checked = []
    exact = near_dedup._Run.exact

    def counted(self, pairs):
        checked.append(pairs.count())
        return exact(self, pairs)

    monkeypatch.setattr(near_dedup._Run, "exact", counted)
    monkeypatch.setattr(near_dedup, "FEW_APART", 0, raising=False)
    monkeypatch.setattr(near_dedup, "TURNS", turns, raising=False)
    base = [f"m{i}" for i in range(203)]
    rows = [(i, " ".join((base if i % 2 else base[:180]) + [f"own{i}"])) for i in range(120)]
    got = grouped((r.id, r.keep_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sorted(map(sorted, got)) == [list(range(120))]
    assert sum(checked) < 1000 if turns else sum(checked) > 60 * 60


def test_pipeline_compares_few_pairs_of_crowds_that_meet(spark, monkeypatch, tmp_path):
    checked = []
    exact = near_dedup._Run.exact
    monkeypatch.setattr(near_dedup._Run, "exact", lambda self, pairs: (checked.append(pairs.count()), exact(self, pairs))[1])
    monkeypatch.setattr(near_dedup, "FEW_APART", 0, raising=False)
    base = [f"p{i}" for i in range(203)]
    rows = [(i, " ".join((base if i % 2 else base[:180]) + [f"own{i}"])) for i in range(120)]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [0] and sum(checked) < 1000


def test_pairs_are_counted_in_slices(spark, monkeypatch):
    """Near dedup of op6_near_dedup and pipeline: all 780 pairs of 40 sets, of which not all are counted at once."""
    written = []
    keep = near_dedup.Shelf.keep

    def counted(self, *tables):
        written.extend(t.count() for t in tables if not isinstance(t, str) and "both" in t.columns)
        return keep(self, *tables)

    monkeypatch.setattr(near_dedup.Shelf, "keep", counted)
    monkeypatch.setattr(near_dedup, "SLICE", 300_000, raising=False)
    cfg, shelf = near_dedup.Ensemble(), near_dedup.Shelf(spark)
    texts = [" ".join([f"s{i}" for i in range(203)] + [f"own{i}"]) for i in range(40)]
    rows = spark.createDataFrame([(str(i), i, t, len(t)) for i, t in enumerate(texts)], "id string, k bigint, t string, len int")
    sets = shelf.keep(rows.mapInArrow(near_dedup._sets(cfg), near_dedup.WIDE))
    x, y = sets.select(F.col("h").alias("a"), F.col("n").alias("na")), sets.select(F.col("h").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, F.col("a") < F.col("b")).select("a", "b", "na", "nb", F.lit(1).alias("least"))
    got = near_dedup._Run(shelf, rows, sets, sets, near_dedup.NO_CLASH, cfg).checked(pairs).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == 780 and {r.both for r in got} == {200}
    assert sum(written) == 780 and max(written) < 500


def test_probes_are_counted_in_shingles():
    rng = np.random.default_rng(4)
    probes = [np.sort(rng.choice(1 << 40, k, replace=False).astype(np.uint64)) for k in (1, 32, 5, 3)]
    es = [[*map(int, probes[0]), 7], list(map(int, probes[1][3:20])), [], list(map(int, probes[1]))]
    packed = [near_dedup._packed(x).tobytes() for x in probes]
    n = len(es)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([1] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(packed, pa.binary()), pa.array(es, pa.list_(pa.int64()))], names=list("abcdef"))
    assert [x for b in near_dedup._met([batch.slice(1), batch.slice(0, 1)]) for x in b.column(4).to_pylist()] == [17, 0, 0, 1]


def test_thousands_of_copies_are_one_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(f"v{i}" for i in range(80)) + " tail"), F.col("id").cast("string")).alias("text"))
    assert [r.doc_id for r in near_dedup.drop_near_copies(rows).collect()] == [0]


def test_near_on_messy_rows(messy, none):
    out = near_dedup.drop_near_copies(messy)
    assert out.columns == messy.columns
    want = Counter((i, t) for i, t, *_ in ROWS)
    for row in ((1, SAME), (2, f"  {SAME.upper()}\n"), (None, SAME)):
        del want[row]
    want[1, SAME] = 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert near_dedup.drop_near_copies(none).count() == 0 and near_dedup.near_groups(none).count() == 0


def test_long_text_is_compared_whole(spark):
    other = " ".join(f"q{i}" for i in range(30_000))
    rows = [(1, LONG + other), (2, LONG + " ".join(f"r{i}" for i in range(30_000))), (3, other)]
    assert near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 2


def test_tables_of_the_driver_start_no_python_workers(spark):
    class Bare:
        def __init__(self):
            self.spark = spark

        def keep(self, df):
            return df

    label = shared._joined(Bare(), spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "a bigint, b bigint"))
    assert {tuple(r) for r in label.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert "ExistingRDD" not in label._jdf.queryExecution().toString()


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 1001)]
    out = components(Shelf(spark), spark.createDataFrame(chain, "a bigint, b bigint"))
    assert {r.node: r.label for r in out.collect()} == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 5000: 1000}
    assert components(Shelf(spark), spark.createDataFrame([], "a bigint, b bigint")).count() == 0
