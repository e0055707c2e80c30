from collections import Counter

import numpy as np
import tiktoken

import __spark_entry__
import corpus_pipeline
from tests.llm import brute
from trovex.llm import bpe, mixing, quality


def test_against_plain_python(spark, sf, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    assert 0.5 * len(rows) < len(judged) < len(rows)
    left = [i for i, _ in brute.exact_kept([(i, rows[i].text) for i in judged])]
    groups = brute.near_groups([(i, rows[i].text) for i in left])
    left = sorted(set(left) - {i for keep, ids in groups for i in ids if i != keep})
    drawn = brute.mixed([(i, rows[i].text, rows[i].lang, rows[i].source) for i in left], mixing.Mix())
    other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})
    want = Counter({(i, tuple(other.encode_ordinary(rows[i].text))): n for i, n in drawn.items()})
    assert Counter((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_stages_on_messy_rows(spark, messy, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (messy, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() > 0 or docs is none
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    assert np.array([len(corpus_pipeline.STAGES)]) == 5
