import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovex.functions import fuzzy, text
from trovex.functions.lang import EXTENSIONS, PATTERNS, language_of, languages


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given_, want", [("hello world", ["hello", "world"]), ("get_user_by_id", ["get", "user", "by", "id"]), ("UserService.login", ["userservice", "login"]), ("", []), (None, []), ("a b hello", ["hello"]), ("f(x){yy}\tzz:ww", ["yy", "zz", "ww"])])
def test_tokens(spark, given_, want):
    assert one(spark, given_, text.tokens) == want
    assert text.query_tokens(given_ or "") == want


def test_ids_go_both_ways(spark):
    made = spark.sql("select 'src/a::b.py' as p, 'A.m' as q, 'Method' as k").select(text.symbol_id(F.col("p"), F.col("q"), F.col("k")).alias("i"))
    assert made.first().i == "src/a::b.py::A.m#method"
    back = spark.sql("select 'src/main.py::User.login#method' as i").select(text.parse_symbol_id(F.col("i")).alias("p")).first().p
    assert tuple(back) == ("src/main.py", "User.login", "method")
    assert tuple(spark.sql("select 'none' as i").select(text.parse_symbol_id(F.col("i")).alias("p")).first().p) == (None, None, None)


def test_hash_and_estimate(spark):
    assert one(spark, "abc", text.content_hash) == "BA7816BF8F01CFEA"
    assert spark.range(1).select(text.token_estimate(F.lit(3), F.lit(14)).alias("n")).first().n == 2


def test_signature_and_summary(spark):
    assert one(spark, "  def f(x):\n  pass", text.signature) == "def f(x):"
    assert one(spark, "x" * 201, text.signature) == "x" * 200 + "..."
    df = spark.createDataFrame([("", "sig", None), ("", " ", None), ("own", "sig", None), ("", "sig", "doc")], "g string, s string, d string")
    got = [r.y for r in df.select(text.summary(F.col("g"), F.col("s"), F.lit("Class"), F.lit("A.b"), F.col("d")).alias("y")).collect()]
    assert got == ["sig", "Class A.b", "own", "doc"]


@pytest.mark.parametrize("language, source, want", [("python", 'def f():\n    """Adds."""\n', "Adds."), ("go", "// Adds.\nfunc f() {}", "Adds."), ("java", "/* Adds. */\nvoid f() {}", "Adds."), ("css", "/* Adds. */", None), ("python", "def f(): pass", None)])
def test_docstring(spark, language, source, want):
    assert one(spark, source, lambda c: text.docstring(c, F.lit(language))) == want


def test_occurrences(spark):
    assert one(spark, "aaaa Aa", lambda c: text.occurrences(c, "AA")) == 3
    with pytest.raises(ValueError):
        text.occurrences(F.col("x"), "")


def test_byte_slice_clamps_and_respects_utf8(spark):
    assert one(spark, "aüb", lambda c: text.byte_slice(c, F.lit(1), F.lit(3))) == "ü"
    assert one(spark, "abc", lambda c: text.byte_slice(c, F.lit(1), F.lit(99))) == "bc"
    assert one(spark, "abc", lambda c: text.byte_slice(c, F.lit(9), F.lit(99))) == ""
    assert one(spark, None, lambda c: text.byte_slice(c, F.lit(0), F.lit(1))) is None


@pytest.mark.parametrize("path, want", [("a/b.py", "python"), ("a.PY", "python"), ("x.tsx", "typescript"), ("x.h", "c"), ("x.cs", "csharp"), ("x.txt", None), ("Makefile", None), (".py", "python")])
def test_language(spark, path, want):
    assert one(spark, path, language_of) == want


def test_language_tables():
    assert len(EXTENSIONS) == 46 + 3 or len(EXTENSIONS) >= 46
    assert len(languages()) == 25 and len(PATTERNS) == 16


@pytest.mark.parametrize("a, b, want", [("authenticate", "authenticate", 100), ("validate", "validateuserinput", 100), ("", "", 100), ("", "x", 0)])
def test_partial_ratio(a, b, want):
    assert fuzzy.partial_ratio(a, b) == want


def test_partial_ratio_typo_and_unrelated():
    assert fuzzy.partial_ratio("authentcate", "authenticate") >= 85
    assert fuzzy.partial_ratio("xyzzy", "authenticate") < 50


@settings(max_examples=60, deadline=None)
@given(st.text("abcde", max_size=14), st.text("abcde", max_size=14))
def test_common_subsequence_against_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert fuzzy._common(a, b) == row[-1]


def test_letters_lose_no_match(spark):
    names = ["authenticate", "auth", "tea", "x", "theca", "cat", "cathode ray tube", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for q in ("authentciate", "auth", "cat"):
        kept = {r.n for r in df.where(fuzzy.letters_allow(q, F.col("n"), 70)).collect()}
        assert {n for n in names if fuzzy.partial_ratio(q, n) >= 70} <= kept
