import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovex.operators import context, filters, search

SYMBOL = "repo_key string, id string, file_path string, qualified_name string, name string, kind string, language string, summary string, keywords array<string>, signature string, byte_start bigint, byte_end bigint"


def symbols(spark, rows):
    return spark.createDataFrame([("r", i, f"{i}.py", n, n, k, lang, s, [], f"def {n}()", 0, 40) for i, n, k, lang, s in rows], SYMBOL)


AUTH = [("s1", "authenticate", "Function", "python", "Validates user credentials"), ("s2", "authorize", "Function", "python", "Checks user permissions"), ("s3", "render_page", "Class", "typescript", "Renders HTML template")]


def ids(df):
    return [r.id for r in df.collect()]


def test_exact_name_first(spark):
    found = search.bm25(symbols(spark, AUTH), "authenticate", search.symbol_text())
    assert ids(search.top(found, 5)) == ["s1"]


def test_summary_and_order(spark):
    rows = [("a", "process_payment", "Function", "python", "Charges a card"), ("b", "send_notification", "Function", "python", "Sends email notification"), ("c", "validate_input", "Function", "python", "Checks a form")]
    assert ids(search.top(search.bm25(symbols(spark, rows), "email notification", search.symbol_text()), 1)) == ["b"]
    scores = [r.score for r in search.top(search.bm25(symbols(spark, rows), "a card form checks", search.symbol_text()), 9).collect()]
    assert scores == sorted(scores, reverse=True) and scores


@pytest.mark.parametrize("q", ["", "xyzzy_nonexistent_term", "!"])
def test_nothing_found(spark, q):
    assert ids(search.bm25(symbols(spark, AUTH), q, search.symbol_text())) == []


def test_no_documents(spark):
    assert ids(search.bm25(symbols(spark, []), "user", search.symbol_text())) == []
    assert ids(search.search_symbols(symbols(spark, []), "user")) == []


def test_repeated_term_counts_twice(spark):
    score = lambda q: {r.id: r.score for r in search.bm25(symbols(spark, AUTH), q, search.symbol_text()).collect()}
    one, two = score("user"), score("user user")
    assert all(abs(two[k] - 2 * one[k]) < 1e-9 for k in one) and len(one) == 2


def test_filter_changes_statistics(spark):
    some = filters.narrowed(symbols(spark, AUTH), language="Python")
    a = {r.id: r.score for r in search.bm25(some, "user", search.symbol_text()).collect()}
    b = {r.id: r.score for r in search.bm25(symbols(spark, AUTH), "user", search.symbol_text()).collect()}
    assert set(a) == {"s1", "s2"} and a["s1"] != b["s1"]


def test_hybrid(spark):
    df = symbols(spark, AUTH)
    assert ids(search.search_symbols(df, "authentcate"))[0] == "s1"
    assert ids(search.search_symbols(df, "render", kind="class")) == ["s3"]
    assert set(ids(search.search_symbols(df, "user", language="python"))) == {"s1", "s2"}
    assert len(ids(search.search_symbols(df, "user", k=1))) == 1
    assert all(r.score > 0 for r in search.search_symbols(df, "user").collect())
    with pytest.raises(ValueError):
        search.search_symbols(df, "user", kind="nonsense")


def test_fused_scores(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.8)], "id string, score double")
    got = {r.id: (round(r.score, 9), r.match_type) for r in search.fused(a, b).collect()}
    assert got == {"x": (round(1 / 61, 9), "BM25"), "y": (round(1 / 62 + 0.5 / 61, 9), "BM25"), "z": (round(0.5 / 62, 9), "Fuzzy")}


def test_text_search_gives_a_row_per_symbol(spark):
    df = symbols(spark, AUTH).withColumn("file_path", F.when(F.col("id") == "s3", "b.py").otherwise("a.py"))
    files = spark.createDataFrame([("r", "a.py", "Foo foo bar"), ("r", "b.py", "none")], "repo_key string, file_path string, content string")
    assert [(r.id, r.score) for r in search.search_text(df, files, "FOO").collect()] == [("s1", 2.0), ("s2", 2.0)]


def test_postings_score_as_whole_texts(spark):
    df = symbols(spark, AUTH)
    index = search.postings(df, search.symbol_text())
    a = {r.id: round(r.score, 9) for r in search.bm25_indexed(index, search.corpus_stats(df, search.symbol_text()), "user html").collect()}
    b = {r.id: round(r.score, 9) for r in search.bm25(df, "user html", search.symbol_text()).collect()}
    assert a == b and len(a) == 3


def plans_exchange(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_made_within_rows_and_over_repeated_ids(spark, monkeypatch):
    rows = [(1, "bb aa bb cc-bb a"), (2, ""), (3, None), (4, "aa " * 3000 + "zz"), (5, "- .")]
    docs = lambda more: spark.createDataFrame(rows + more, "id bigint, text string")
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    once = [(1, "aa", 1), (1, "bb", 3), (1, "cc", 1), (4, "aa", 3000), (4, "zz", 1)]
    found = search.term_counts(docs([]), F.col("text"))
    assert got(found) == once and not plans_exchange(found)
    assert {(r.term, r.tf, r.len) for r in search.postings(docs([]), F.col("text")).collect() if r.id == 1} == {("aa", 1, 5), ("bb", 3, 5), ("cc", 1, 5)}
    assert not plans_exchange(search.postings(docs([]), F.col("text")))
    more = [(4, "aa yy"), (5, "aa"), (None, "aa bb"), (None, "aa")]
    want = sorted([(1, "aa", 1), (1, "bb", 3), (1, "cc", 1), (4, "aa", 3001), (4, "yy", 1), (4, "zz", 1), (5, "aa", 1), (None, "aa", 2), (None, "bb", 1)], key=repr)
    for many in (search.MANY, 1):
        monkeypatch.setattr(search, "MANY", many)
        assert got(search.term_counts(docs(more), F.col("text"))) == want


def greedy(items, budget):
    used, out = 0, []
    for s, i, t in sorted(items, key=lambda x: (-x[0], x[1])):
        if used + t <= budget:
            used += t
            out.append(i)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 60)), min_size=1, max_size=12), st.integers(0, 100))
def test_packing_skips_and_goes_on(spark, sizes, budget):
    items = [(float(s), i, t) for i, (s, t) in enumerate(sizes)]
    df = spark.createDataFrame(items, "score double, id bigint, tokens bigint")
    rows = sorted(context.packed(df, budget).collect(), key=lambda r: r.pos)
    assert [r.id for r in rows] == greedy(items, budget)
    assert sum(r.tokens for r in rows) <= budget
    assert all(r.excluded == len(items) - len(rows) for r in rows)


def test_context_and_batches(spark):
    df = symbols(spark, AUTH)
    files = spark.createDataFrame([("r", "s1.py", "x" * 100), ("r", "s2.py", "ü" * 50)], "repo_key string, file_path string, content string")
    row = context.ranked_context(search.search_symbols(df, "user"), df, files, "user", 15).first()
    assert row.used_tokens == 10 and row.excluded_count == 1 and len(row.symbols) == 1
    want = spark.createDataFrame([(0, "s2"), (1, "s3"), (2, "s2"), (3, "none")], "pos bigint, id string")
    got = [(r.id, r.source) for r in context.batch_sources(want, df, files).collect()]
    assert got == [("s2", "ü" * 20), ("s3", "def render_page()"), ("s2", "ü" * 20)]


def test_ranks_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    rows = spark.range(5000).select("id", (F.col("id") % 37).cast("double").alias("score"))
    want = {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 37), i)), 1)}
    for most in (search.ONE_TASK, 10):
        monkeypatch.setattr(search, "ONE_TASK", most)
        assert {r.id: r.r for r in search.ranks(rows, "r").collect()} == want
        assert search.ranks(rows.where("false"), "r").count() == 0
