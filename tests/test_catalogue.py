import difflib
import hashlib
import itertools

import pytest

from trovex.functions.fuzzy import partial_ratio
from trovex.plans import catalogue
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_as_duckdb(spark, sf, db, name):
    assert same(spark, db, catalogue.QUERIES[name], catalogue.SQL[name], sf) > 0


def test_fuzzy_names_against_all_pairs(spark, sf):
    got = {(r.id, r.score) for r in catalogue.fuzzy_names(spark, sf).collect()}
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()
    want = {(k, s / 100) for k, n in parts if (s := partial_ratio(catalogue.NAME.lower(), n.lower())) >= 70}
    assert got == want and got


def slow_partial_ratio(a, b):
    """Windows of the longer string at the places where the two have a block in common, by the plain recurrence."""
    a, b = sorted((a, b), key=len)
    best = 0.0
    for i, j, _ in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        part = b[max(0, j - i) : max(0, j - i) + len(a)]
        row = [0] * (len(part) + 1)
        for x in a:
            row = list(itertools.accumulate(zip(part, row, row[1:]), lambda left, c: max(c[2], left, c[1] + 1 if x == c[0] else 0), initial=0))
        best = max(best, 200 * row[-1] / (len(a) + len(part)) if part else 0)
    return round(best)


def test_partial_ratio_against_plain_recurrence(spark, sf):
    names = [r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").collect()]
    for n in [*names, "", "a", catalogue.NAME]:
        assert partial_ratio(catalogue.NAME, n) == slow_partial_ratio(catalogue.NAME, n)
    assert [partial_ratio(*x) for x in (("auth", "authenticate"), ("authentciate", "authenticate"), ("abc", "xyz"), ("", ""), ("", "a"))] == [100, 92, 0, 100, 0]


def test_hybrid_is_ranked(spark, sf):
    rows = catalogue.hybrid_full(spark, sf).collect()
    assert 0 < len(rows) <= 20 and {r.match_type for r in rows} <= {"BM25", "Fuzzy"}


@pytest.mark.parametrize("name", ["json_export", "stream_ingest"])
def test_texts_go_through_whole(spark, tmp_path, name):
    texts = ['"quoted" \\ back\\nslash', "line\nfeed\r\n\ttab \x00 \x1f \x7f", "é漢字 🙂 \u2028", "", None, "</script> {\"a\": [1]}", "long " * 200_000 + '"' * 50_000]
    rows = [(i, t, "en", None if i == 2 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select("doc_id", "lang", "source", "n_chars", "text_hash").collect()}
    assert got == {(i, lang, s, n, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, lang, s, n in rows}


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
