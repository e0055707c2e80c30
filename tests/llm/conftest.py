import pytest

LONG = "the quick brown fox jumps over lazy dogs again and again until evening " * 4000
SAME = "Alpha beta gamma delta epsilon zeta eta theta"
#: Names that the operators use within; as columns of the input they must come through.
CLASHES = "Norm seal head size place key value score t tokens id k len h label row again range full rest cut domain epochs keep shard n keys sketch node a b good x bin some before upto number digest payload header url license matches words phrases starts exact n_tokens".split()
ROWS = [
    (1, SAME, "en", "src1"), (1, SAME, "en", "src1"), (2, f"  {SAME.upper()}\n", "de", "src2"), (None, SAME, None, None), (3, None, "en", "src1"), (3, None, "en", None),
    (None, None, None, "src3"), (4, "", "fr", "src0"), (5, " \t\n ", "fr", "src0"), (6, LONG, "en", "src1"), (7, "é漢字 🙂 licensed under the MIT License", "es", "odd"), (8, "a", "", ""),
    (-9, "aaaa aaaa aaaa aaaa", "en", "src5"), (9, "x" * 5000, "en", "src5"),
]


@pytest.fixture(scope="session")
def messy(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *([None if i == 2 else "clash"] * len(CLASHES))) for i, t, lang, s in ROWS], kinds).repartition(3).cache()


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (1, 0, 0, "z"), (6, 1, None, "z"), (7, 1, 1, None), (8, 0, 0, "z"), (9, 0, 0, "z"), (None, 1, 0, "z"), (4, None, 0, "z"), (77, 1, 0, "z")], "doc_id bigint, quality int, toxic int, score string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
