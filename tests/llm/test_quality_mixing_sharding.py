import math
from collections import Counter
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.conftest import ROWS
from tests.oracle import connect, same
from trovex.llm import kernel, mixing, quality, queries, sharding


def test_features_as_in_python(docs):
    texts = [r.text for r in docs.collect()] + [t for _, t, *_ in ROWS]
    got = quality.features(kernel.text_array(pa.array(texts)))
    assert np.allclose(got, np.array([brute.quality_features(t) for t in texts]), atol=1e-9)


def test_quality_query_against_plain_python(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    w = quality.train(docs, labels)
    score = {r.doc_id: float(np.array(brute.quality_features(r.text)) @ w) for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(score)
    ranked = sorted(math.floor(score[i] * 1000 + 1e-6) for i in good)
    low = ranked[math.floor(quality.Ranker().reject_share * len(ranked))] / 1000
    for r in queries.op8_quality(spark, sf).collect():
        assert abs(r.score - score[r.doc_id]) < 2e-4
        assert r.keep == (score[r.doc_id] >= low) or abs(score[r.doc_id] - low) < 2e-3


def test_held_out_pairs(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    w = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    s = quality.features(kernel.text_array(pa.array([r.text for r in rows]))) @ w
    y = np.array([r.quality for r in rows])
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.9


def test_fit_lowers_the_pairwise_loss():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.5, 1, (300, 11)), rng.normal(0, 1, (200, 11))
    w = quality.fit(good, bad)
    loss = lambda v: np.log1p(np.exp(-((good[:, None] - bad[None]) @ v))).mean()
    assert loss(w) < loss(w * 0) and loss(w) < loss(w * 1.3) and loss(w) < loss(w * 0.7)
    assert not quality.fit(good, bad[:0]).any() and (quality.fit(good, bad) == w).all()


def test_quality_on_messy_rows(messy, none, labels):
    rows = quality.quality_scores(messy, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ROWS)
    assert all((r.score is None) == (r.doc_id is None and r.score is None or r.doc_id == 3) for r in rows)
    assert not any(r.keep for r in rows if r.doc_id in (3, 4)) and all(r.keep for r in rows if r.doc_id in (1, 6, 7))
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.keep)
    for some in (labels.where("false"), labels.where("quality = 1")):
        assert quality.keep_good(messy, some).count() == sum(bool(t) for _, t, *_ in ROWS)
    assert quality.keep_good(none, labels).count() == quality.quality_scores(none, labels).count() == 0


def test_mixing_as_duckdb(spark, sf):
    assert same(spark, connect(sf), queries.QUERIES["op7_mixing"], queries.SQL["op7_mixing"], sf) > 0


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(budget=0.3, epochs=1, seed=3), mixing.Mix(budget=5.0, epochs=2), mixing.Mix(weights=MappingProxyType({"domain": {"d1": 100}, "lang": {"fr": 50}, "source": {"src1": 9}}), budget=0.9, epochs=4)])
def test_mixing_against_plain_python(docs, mix):
    got = {r.doc_id: r.epochs for r in mixing.mixture(docs, mix).collect()}
    assert got == brute.mixed([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], mix)
    assert mixing.mixed(docs, mix).count() == sum(got.values())


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 1000)]
    plan = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), mixing.Mix(weights=MappingProxyType({}), budget=400 / 3010, epochs=1))
    got = {r.source: r.budget for r in plan.collect()}
    assert abs(got["a"] - 10) <= 1 and abs(got["b"] - 90) <= 1 and abs(got["c"] - 100) <= 1 and abs(got["e"] - 200) <= 1


def test_mixing_on_messy_rows(messy, none):
    mix = mixing.Mix(budget=10.0, epochs=2)
    out = mixing.mixed(messy, mix)
    assert out.columns == messy.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([i for i, t, *_ in ROWS if t] * 2)
    some = mixing.mixture(messy, mixing.Mix(budget=0.5)).collect()
    assert 0 < sum(r.tokens * r.epochs for r in some) <= 0.5 * sum(-(-len(t.encode()) // 4) for _, t, *_ in ROWS if t)
    assert mixing.mixed(none).count() == mixing.mixture(none).count() == 0


def test_sharding_query_against_dynamic_programming(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.shard, r.size) for r in queries.op9_sharding(spark, sf).collect())
    assert got == sorted(brute.shards(rows, sharding.Shards().number))


@pytest.mark.parametrize("number", [1, 2, 7, 1000])
def test_sharding_into(docs, number, monkeypatch):
    monkeypatch.setattr(sharding, "FINER", 4)  # so that cells are read in finer ones
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.shard, r.size) for r in sharding.assigned(docs, sharding.Shards(number)).collect())
    assert got == sorted(brute.shards(rows, number))


def test_sharding_on_messy_rows(messy, none, spark):
    key = lambda x: (str(x[0]), x[1:])
    for number in (1, 3):
        got = [(r.doc_id, r.shard, r.size) for r in sharding.assigned(messy, sharding.Shards(number)).collect()]
        assert sorted(got, key=key) == sorted(brute.shards([(i, t) for i, t, *_ in ROWS], number), key=key)
    assert sharding.assigned(none).count() == 0
    hollow = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert {r.shard for r in sharding.assigned(hollow).collect()} == {0}


def newton(good, bad, cfg, seed):
    """Weights by Newton's method on all of the drawn pairs' differences."""
    both = np.concatenate([good, bad])
    scale = np.where(both.std(0) > 1e-9, both.std(0), np.inf)
    rng = np.random.default_rng(seed)
    d = (good[rng.integers(0, len(good), cfg.pairs)] - bad[rng.integers(0, len(bad), cfg.pairs)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + cfg.ridge * np.eye(len(w)), -(d * (1 - p)[:, None]).mean(0) + cfg.ridge * w)
    return w / scale


def test_fit_ranks_as_newton_does():
    rng = np.random.default_rng(0)
    n = len(quality.FEATURES)
    good, bad = rng.normal(0.5, 1, (400, n)), rng.normal(0, 1, (400, n))
    cfg = quality.Ranker(pairs=4000)
    x = rng.normal(0, 1, (500, n))
    assert np.corrcoef(x @ quality.fit(good, bad, cfg), x @ newton(good, bad, cfg, cfg.seed))[0, 1] > 0.99


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id % 2 as doc_id", "concat('some words ', id) as text")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda good, bad, cfg: seen.append(len(good) + len(bad)) or np.zeros(len(quality.FEATURES)))
    quality.train(docs, labels, quality.Ranker(train_docs=50))
    assert seen == [50]


def test_mixing_by_given_domain_and_tokens(spark):
    rows = [(i, "x", "en", "s", "a" if i % 2 else None, 10) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, dom string, n int")
    mix = mixing.Mix(weights={"domain": {"a": 3, "(none)": 1}}, budget=0.5, epochs=1)
    got = mixing.mixture(docs, mix, domain="dom", tokens="n").groupBy("domain").sum("tokens").collect()
    assert {tuple(r) for r in got} == {("a", 150), ("(none)", 50)}
