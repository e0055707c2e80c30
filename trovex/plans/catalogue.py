"""The operators applied to the test tables, each with DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovex.functions import text as tx
from trovex.functions.lang import language_of, language_sql
from trovex.operators import context, extract, filters, graph, incremental, intervals, outline, search
from trovex.shelf import Shelf, workers_find_us
from trovex.sources.store import write_json
from trovex.streaming.watch import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What is looked for: words of the invented languages and of license lines.
SEARCH = "licensed under the apache tion erblen einung"
SHORT = "license version eaux"
NEEDLE = "licens"
NAME = "smal gaer"
BUDGET = 4000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bm25_sql(query: str, source: str = "documents", where: str = "true") -> str:
    """CTEs ending in scored(doc_id, score), unrounded."""
    terms: dict[str, int] = {}
    for t in tx.query_tokens(query):
        terms[t] = terms.get(t, 0) + 1
    one = "1.0::DOUBLE"
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(terms)))
    k1, b = f"{search.K1}::DOUBLE", f"{search.B}::DOUBLE"
    parts = [
        f"CASE WHEN tf{i} > 0 THEN {m}.0::DOUBLE * ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + {one}) * (tf{i} * ({k1} + 1) / (tf{i} + {k1} * (1 - {b} + {b} * dl / mean))) ELSE 0::DOUBLE END"
        for i, m in enumerate(terms.values())
    ]
    return f"""toks AS (SELECT doc_id, {tx.tokens_sql("text")} AS toks FROM {source} WHERE {where}),
tf AS (SELECT doc_id, len(toks)::DOUBLE AS dl, {tf} FROM toks),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {df} FROM tf),
scored AS (SELECT doc_id, {" + ".join(parts)} AS score FROM tf, st WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))})"""


def _bm25(docs: DataFrame, q: str) -> DataFrame:
    return search.bm25(docs.select("doc_id", "text"), q, F.col("text"), "doc_id").select("doc_id", "score")


@query(f"WITH {bm25_sql(SEARCH)} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.top(_bm25(table(spark, sf_dir, "documents"), SEARCH), 20, "doc_id")
    return best.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(SEARCH)} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(table(spark, sf_dir, "documents"), SEARCH).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(SEARCH)} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = table(spark, sf_dir, "documents"), Shelf(spark)
    index = search.postings(docs, F.col("text"), "doc_id")
    path = f"{shelf.base}/postings"
    index.repartition("bucket").write.partitionBy("bucket").parquet(path)
    found = search.bm25_indexed(spark.read.parquet(path), search.corpus_stats(docs, F.col("text")), SEARCH)
    return found.where("score > 0").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {bm25_sql(SHORT, where='''lower(lang) = 'en' ''')} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filters.narrowed(table(spark, sf_dir, "documents").withColumnRenamed("lang", "language"), language="EN")  # below the statistics, which it changes
    return _bm25(docs, SHORT).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {tx.tokens_sql('text')} AS t FROM documents)")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tx.tokens_sql('text')})) AS term FROM documents) GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tx.tokens_sql('text')})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50")
def doc_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_freq(spark, sf_dir).orderBy(F.desc("df"), "term").limit(50)


@query(f"SELECT doc_id, term, count(*)::INT AS tf FROM (SELECT doc_id, unnest({tx.tokens_sql('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(f"""WITH hits AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) // {len(NEEDLE)} AS n FROM documents)
SELECT l.doc_id, l.quality, l.toxic, n::DOUBLE AS score FROM labels l JOIN hits USING (doc_id) WHERE n > 0""")
def text_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are documents, their symbols the labels: a text is read once for all."""
    hits = table(spark, sf_dir, "documents").select("doc_id", tx.occurrences(F.col("text"), NEEDLE).cast("double").alias("score")).where("score > 0")
    return table(spark, sf_dir, "labels").join(hits, "doc_id").select("doc_id", "quality", "toxic", "score")


@query(f"""WITH hits AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) // {len(NEEDLE)} AS n FROM documents)
SELECT l.doc_id, l.quality, n::DOUBLE AS score, 'Exact' AS match_type FROM labels l JOIN hits USING (doc_id) WHERE n > 0 ORDER BY n DESC, l.doc_id LIMIT 20""")
def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are documents, their symbols the labels."""
    symbols = table(spark, sf_dir, "labels").select(*_file(F.col("doc_id")), F.col("doc_id").alias("id"), "quality")
    return search.search_text(symbols, _sources(spark, sf_dir), NEEDLE).select(F.col("id").alias("doc_id"), "quality", "score", "match_type")


def _file(id: Column) -> list[Column]:
    return [F.lit("docs").alias("repo_key"), F.concat(F.lit("doc/"), id.cast("string")).alias("file_path")]


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw_source."""
    return table(spark, sf_dir, "documents").select(*_file(F.col("doc_id")), F.col("text").alias("content"))


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.fuzzy(names, NAME).select("id", "name", "score")


@query(f"""WITH {bm25_sql(SEARCH)},
r1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r1 FROM scored WHERE score > 0),
c AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), '{NEEDLE}', ''))) // {len(NEEDLE)} AS n FROM documents),
r2 AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS r2 FROM c WHERE n > 0)
SELECT doc_id, round(coalesce(1.0::DOUBLE / (60.0::DOUBLE + r1), 0::DOUBLE) + coalesce(0.5::DOUBLE / (60.0::DOUBLE + r2), 0::DOUBLE), 9) AS score, CASE WHEN r1 IS NOT NULL THEN 'BM25' ELSE 'Fuzzy' END AS match_type
FROM r1 FULL JOIN r2 USING (doc_id)""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", tx.occurrences(F.col("text"), NEEDLE).alias("score")).where("score > 0")
    return search.fused(_bm25(docs, SEARCH), counted, "doc_id").select("doc_id", F.round("score", 9).alias("score"), "match_type")


def _part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("parts").alias("repo_key"), tx.symbol_id(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")), F.col("p_name"), F.lit("Function")).alias("id"), F.col("p_brand").alias("file_path"),
        F.col("p_name").alias("qualified_name"), F.lit("Function").alias("kind"), F.col("p_name").alias("name"), F.lit("python").alias("language"), F.col("p_type").alias("summary"), F.array().cast("array<string>").alias("keywords"),
    )


@query()
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_symbols(_part_symbols(spark, sf_dir), NAME, kind="function").select("id", "name", F.round("score", 9).alias("score"), "match_type")


BEST_SQL = f"""{bm25_sql(SEARCH)},
best AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rn, doc_id, octet_length(encode(text)) // 4 AS tokens FROM scored JOIN documents USING (doc_id) WHERE score > 0 QUALIFY rn <= 50),
pack AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS used, false AS taken UNION ALL
  SELECT b.rn, CASE WHEN used + tokens <= {BUDGET} THEN used + tokens ELSE used END, used + tokens <= {BUDGET} FROM pack p JOIN best b ON b.rn = p.rn + 1)"""


@query(f"""WITH RECURSIVE {BEST_SQL}
SELECT doc_id, tokens::BIGINT AS tokens, row_number() OVER (ORDER BY rn)::INT AS pos FROM pack JOIN best USING (rn) WHERE taken""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    best = search.top(_bm25(docs, SEARCH), context.CANDIDATES, "doc_id")
    sized = docs.select("doc_id", tx.token_estimate(F.lit(0), F.octet_length("text")).alias("tokens")).join(F.broadcast(best), "doc_id")  # CANDIDATES rows
    return context.packed(sized, BUDGET, id="doc_id").select(F.col("id").alias("doc_id"), "tokens", F.col("pos").cast("int").alias("pos"))


def _doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a symbol from the byte after its first blank to its end."""
    start = F.octet_length(F.substring_index("text", " ", 1)) + 1
    d = table(spark, sf_dir, "documents")
    return d.select(
        *_file(F.col("doc_id")), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.lit("Function").alias("kind"), F.lit("none").alias("signature"),
        start.cast("bigint").alias("byte_start"), F.octet_length("text").cast("bigint").alias("byte_end"),
    )


@query(f"""WITH RECURSIVE {BEST_SQL.replace("DESC, doc_id", "DESC, doc_id::VARCHAR")}
SELECT '{SEARCH}' AS query, {BUDGET} AS budget_tokens, coalesce(sum(tokens) FILTER (taken), 0)::BIGINT AS used_tokens, (SELECT count(*) FROM best)::INT - count(*) FILTER (taken)::INT AS excluded_count,
  string_agg(doc_id || ':' || left(sha256(text), 8), ' ' ORDER BY rn) FILTER (taken) AS symbols FROM pack JOIN best USING (rn) JOIN documents USING (doc_id)""")
def ranked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _doc_symbols(spark, sf_dir).withColumn("byte_start", F.lit(0).cast("bigint"))
    found = search.top(search.bm25(_sources(spark, sf_dir).withColumn("id", F.substring_index("file_path", "/", -1)), SEARCH, F.col("content")), context.CANDIDATES)
    found = symbols.join(F.broadcast(found), "id")  # CANDIDATES rows
    one = context.ranked_context(found, symbols, _sources(spark, sf_dir), SEARCH, BUDGET)
    said = F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x.id, F.left(F.sha2(x.source.cast("binary"), 256), F.lit(8)))), " ")
    return one.select("query", "budget_tokens", F.col("used_tokens").cast("bigint").alias("used_tokens"), "excluded_count", said.alias("symbols"))


@query("SELECT doc_id::VARCHAR AS id, sha256(CASE WHEN strpos(text, ' ') > 0 THEN substr(text, strpos(text, ' ') + 1) ELSE '' END) AS source_hash FROM documents WHERE text IS NOT NULL")
def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's source, cut from its file by bytes."""
    found = context.symbol_sources(_doc_symbols(spark, sf_dir), _sources(spark, sf_dir)).where("source is not null")
    return found.select("id", F.sha2(F.col("source").cast("binary"), 256).alias("source_hash"))


@query("""SELECT l.doc_id AS pos, d.doc_id::VARCHAR AS id, coalesce(upper(left(sha256(CASE WHEN strpos(text, ' ') > 0 THEN substr(text, strpos(text, ' ') + 1) ELSE '' END), 16)), upper(left(sha256('none'), 16))) AS content_hash
FROM labels l JOIN documents d USING (doc_id)""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"))
    return context.batch_sources(ids, _doc_symbols(spark, sf_dir), _sources(spark, sf_dir)).select("pos", "id", tx.content_hash(F.col("source")).alias("content_hash"))


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'Class' WHEN 'fr' THEN 'Interface' ELSE 'Function' END AS kind, '" + graph.DEAD_REASON + "' AS reason FROM documents WHERE coalesce(lang, '') NOT IN ('es', 'fr') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are symbols, of kinds by language, and labels refer to them."""
    kind = F.when(F.col("lang") == "es", "Class").when(F.col("lang") == "fr", "Interface").otherwise("Function").alias("kind")
    uses = table(spark, sf_dir, "labels").select(F.lit(0).alias("src_id"), F.col("doc_id").alias("dst_id"))
    return graph.dead_symbols(table(spark, sf_dir, "documents").select("doc_id", kind), uses, "doc_id").select("doc_id", "kind", "reason")


@query()
def dead_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are symbols, and every line refers to one. The test tables have a line for every part, so no row comes out."""
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    return graph.dead_symbols(table(spark, sf_dir, "part"), uses, "p_partkey", None).select("p_partkey", "p_name", "reason")


@query("SELECT DISTINCT l_partkey FROM lineitem")
def referenced_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey").distinct()


EDGES_SQL = """edges AS (SELECT l_partkey AS src_id, nxt AS dst_id, l_quantity AS q FROM (
  SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part leads to the next one of its order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nxt = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src_id"), F.lead("l_partkey").over(order).alias("dst_id"), F.col("l_quantity").alias("q"))
    return nxt.where("dst_id is not null")


@query(f"WITH {EDGES_SQL} SELECT src_id, count(*) AS out_degree FROM edges GROUP BY src_id")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).groupBy("src_id").agg(F.count(F.lit(1)).alias("out_degree"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all edges, with the operator's own rounds and tolerance; a loop to a tolerance has no SQL here."""
    return graph.pagerank(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), part_edges(spark, sf_dir))


@query()
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir).select("id", F.round("rank", 6).alias("rank"))


@query()
def importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _ranks(spark, sf_dir).withColumn("centrality_score", F.round("rank", 9))
    return graph.importance(ranks).select("id", F.round("score", 6).alias("score"), "match_type")


@query(f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src_id, dst_id FROM edges),
walk AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT e.src_id, depth + 1 FROM walk JOIN e ON e.dst_id = walk.id WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM walk WHERE id <> 1 GROUP BY id""")
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(part_edges(spark, sf_dir), 1)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS parent FROM conversations),
tree AS (SELECT id, id AS root_id, 0 AS depth FROM t WHERE parent NOT IN (SELECT id FROM t)
  UNION ALL SELECT t.id, tree.root_id, depth + 1 FROM tree JOIN t ON t.parent = tree.id)
SELECT id, root_id, depth, (SELECT count(*) FROM t WHERE t.parent = tree.id)::INT AS child_count FROM tree""")
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat_ws(":", "conv_id", (F.col("turn") - 1)).alias("parent_id"), F.col("turn").alias("start_line"))
    return outline.outline(t).select("id", "root_id", "depth", "child_count")


@query("""WITH l AS (SELECT l.*, o_custkey FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT DISTINCT o_custkey, l_shipdate FROM l),
f AS (SELECT k.o_custkey, l_shipdate, first(o.o_orderkey ORDER BY o_orderdate DESC, o.o_orderkey) AS around FROM k JOIN orders o ON o.o_custkey = k.o_custkey AND o_orderdate <= l_shipdate AND o_orderdate + INTERVAL 30 DAY >= l_shipdate GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, around FROM l LEFT JOIN f USING (o_custkey, l_shipdate)""")
def enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    days = orders.select("o_custkey", "o_orderkey", "o_orderdate")
    point = (F.col("l_shipdate"), F.col("l_shipdate"))
    found = intervals.enclosing(lines.select("o_custkey", "l_shipdate").distinct(), days, "o_custkey", point, (F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days")), ["l_shipdate"], "o_orderkey", "around")
    return lines.join(found, ["o_custkey", "l_shipdate"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "around")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase FROM events""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return intervals.nearest_preceding(events, "user_id", [F.col("ts"), F.col("event_id")], F.col("event_id"), F.col("event_type") == "purchase", "purchase").select("event_id", "user_id", "purchase")


DIFF_SQL = """old AS (SELECT 'doc/' || doc_id AS path, upper(left(sha256(text || toxic), 16)) AS h FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'item/' || item_id, upper(left(sha256(text), 16)) FROM benchmark),
new AS (SELECT 'doc/' || doc_id AS path, upper(left(sha256(text || '0'), 16)) AS h FROM documents),
diff AS (SELECT path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' WHEN old.h IS NOT DISTINCT FROM new.h THEN 'unchanged' ELSE 'modified' END AS status FROM old FULL JOIN new USING (path))"""


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old listing of labelled documents (changed where toxic) and benchmark items, a new one of all documents."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    old = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(path, tx.content_hash(F.concat("text", F.col("toxic").cast("string"))).alias("file_hash"))
    old = old.union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item/"), F.col("item_id").cast("string")), tx.content_hash(F.col("text"))))
    return old, docs.select(path, tx.content_hash(F.concat("text", F.lit("0"))).alias("file_hash"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest_diff(*_listings(spark, sf_dir))


@query(f"WITH {DIFF_SQL} SELECT path, status FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"WITH {DIFF_SQL} SELECT 'doc/' || doc_id AS file_path, quality, status AS change FROM labels JOIN diff ON path = 'doc/' || doc_id WHERE status <> 'unchanged'")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "quality")
    return graph.changed_symbols(symbols, _diff(spark, sf_dir).where("status <> 'unchanged'"))


@query("SELECT doc_id, upper(left(sha256(text), 16)) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


PATHS_SQL = """paths AS (SELECT doc_id, n_chars * 20 AS size, CASE lang WHEN 'en' THEN source || '/file' || doc_id || '.py' WHEN 'de' THEN source || '/build/' || doc_id || '.CS' WHEN 'fr' THEN 'lib/' || source || '.' || lang || '/' || doc_id || '.tsx' ELSE source || '/..' || doc_id || '.unknown' END AS path FROM documents)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    path = (
        F.when(F.col("lang") == "en", F.concat("source", F.lit("/file"), i, F.lit(".py"))).when(F.col("lang") == "de", F.concat("source", F.lit("/build/"), i, F.lit(".CS")))
        .when(F.col("lang") == "fr", F.concat(F.lit("lib/"), F.col("source"), F.lit("."), F.col("lang"), F.lit("/"), i, F.lit(".tsx"))).otherwise(F.concat("source", F.lit("/.."), i, F.lit(".unknown")))
    )
    return d.select("doc_id", (F.col("n_chars") * 20).alias("size"), path.alias("path"))


@query(f"WITH {PATHS_SQL} SELECT doc_id, path, {language_sql('path')} AS language FROM paths WHERE {language_sql('path')} IS NOT NULL")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("language", language_of(F.col("path"))).where("language is not null").select("doc_id", "path", "language")


def _in(names: frozenset) -> str:
    return "(" + ", ".join(f"'{n}'" for n in sorted(names)) + ")"


@query(f"""WITH {PATHS_SQL} SELECT doc_id, path, size <= 50000 AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN {_in(filters.BINARY | filters.SECRET_ENDINGS)}
  AND lower(regexp_extract(path, '([^/]*)$', 1)) NOT IN {_in(filters.SECRET_NAMES)} AND NOT list_has_any(string_split(lower(path), '/'), [{_in(filters.SKIPPED)[1:-1]}]) AND NOT contains(path, '..')
  AND NOT regexp_matches(path, '^src1/.*\\.py$') AS kept FROM paths""")
def security_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and an ignore file that leaves one source's Python out."""
    return _paths(spark, sf_dir).select("doc_id", "path", filters.should_index(F.col("path"), F.col("size"), 50_000, ["/src1/**/*.py"]).alias("kept"))


@query("SELECT DISTINCT url AS path FROM pages WHERE starts_with(lower(url), 'http')")
def path_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.file_tree(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "HTTP")


@query("""SELECT id, regexp_extract(id, '(?s)^(.*?)::(.*)#([^#]*)$', 1) AS file_path, regexp_extract(id, '(?s)^(.*?)::(.*)#([^#]*)$', 2) AS qualified_name, regexp_extract(id, '(?s)^(.*?)::(.*)#([^#]*)$', 3) AS kind
FROM (SELECT p_brand || '/' || p_partkey || '::' || p_name || '#function' AS id FROM part)""")
def symbol_id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_symbols(spark, sf_dir).select("id", tx.parse_symbol_id(F.col("id")).alias("p")).select("id", "p.*")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 10 THEN p_type ELSE 'Function ' || p_brand END AS summary FROM part")
def summary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, sign = F.when(F.col("p_size") > 25, F.col("p_name")), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", tx.summary(given, sign, F.lit("Function"), F.col("p_brand")).alias("summary"))


CODE_SQL = """code AS (SELECT doc_id AS i, coalesce(lang, '') AS lang, coalesce(n_chars, 0) AS n FROM documents),
made AS (SELECT i || '.py::load' || i || '#function' AS id, 'Function' AS kind, 'load' || i AS name, 'def load' || i || '(path):' AS signature, 'Gives ' || n || '.' AS summary, 0 AS byte_start, 'def load' || i || '(path):' || chr(10) || '    "Gives ' || n || '."' || chr(10) || '    return ' || n AS text, 1 AS start_line, 3 AS end_line, NULL AS parent_id FROM code WHERE lang NOT IN ('de', 'fr', 'es')
UNION ALL SELECT i || '.py::Box' || i || '#class', 'Class', 'Box' || i, 'class Box' || i || ':', 'class Box' || i || ':', length('def load' || i || '(path):' || chr(10) || '    "Gives ' || n || '."' || chr(10) || '    return ' || n) + 3, 'class Box' || i || ':' || chr(10) || '    def size(self):' || chr(10) || '        return "é"', 6, 8, NULL FROM code WHERE lang NOT IN ('de', 'fr', 'es')
UNION ALL SELECT i || '.py::Box' || i || '.size#method', 'Method', 'size', 'def size(self):', 'def size(self):', length('def load' || i || '(path):' || chr(10) || '    "Gives ' || n || '."' || chr(10) || '    return ' || n || 'class Box' || i || ':') + 8, 'def size(self):' || chr(10) || '        return "é"', 7, 8, i || '.py::Box' || i || '#class' FROM code WHERE lang NOT IN ('de', 'fr', 'es')
UNION ALL SELECT i || '.go::run' || i || '#function', 'Function', 'run' || i, 'func run' || i || '(n int) {', 'Runs it.', 12, 'func run' || i || '(n int) {' || chr(10) || chr(9) || 'if n > ' || n || ' {' || chr(10) || chr(9) || '}' || chr(10) || '}', 2, 5, NULL FROM code WHERE lang = 'de'
UNION ALL SELECT i || '.cs::Item' || i || '#class', 'Class', 'Item' || i, 'public class Item' || i, 'public class Item' || i, 0, 'public class Item' || i || chr(10) || '{' || chr(10) || '}', 1, 3, NULL FROM code WHERE lang = 'fr'
UNION ALL SELECT i || '.hs::area' || i || '#function', 'Function', 'area' || i, 'area' || i || ' :: Int', 'area' || i || ' :: Int', 0, 'area' || i || ' :: Int' || chr(10) || 'area' || i || ' = ' || n || chr(10), 1, 3, NULL FROM code WHERE lang = 'es')"""


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for every document, in a language that goes by the text's; the tables hold no code."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("n_chars", F.lit(0)).cast("string").alias("n"))
    say = lambda *parts: F.concat(*[F.col(x) if x in ("i", "n") else F.lit(x) for x in parts])
    text = F.when(F.col("lang") == "de", say("// Runs it.\nfunc run", "i", "(n int) {\n\tif n > ", "n", " {\n\t}\n}\n")).when(F.col("lang") == "fr", say("public class Item", "i", "\n{\n}\n"))
    text = text.when(F.col("lang") == "es", say("area", "i", " :: Int\narea", "i", " = ", "n", "\n")).otherwise(say("def load", "i", '(path):\n    "Gives ', "n", '."\n    return ', "n", "\n\n\nclass Box", "i", ':\n    def size(self):\n        return "é"\n'))
    ending = F.when(F.col("lang") == "de", "go").when(F.col("lang") == "fr", "cs").when(F.col("lang") == "es", "hs").otherwise("py")
    path = F.concat_ws(".", "i", ending)
    return d.select(F.lit("made").alias("repo_key"), path.alias("path"), language_of(path).alias("language"), text.alias("content"))


@query(f"WITH {CODE_SQL} SELECT id, kind, name, signature, summary, byte_start::BIGINT AS byte_start, (byte_start + octet_length(encode(text)))::BIGINT AS byte_end, start_line, end_line, parent_id, upper(left(sha256(text), 16)) AS content_hash FROM made")
def extract_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract_symbols(source_files(spark, sf_dir))
    return found.select("id", "kind", "name", "signature", "summary", "byte_start", "byte_end", "start_line", "end_line", "parent_id", "content_hash")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND starts_with(lower(p_brand), 'brand#1')")
def symbols_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, "Class").otherwise("Enum").alias("kind"), F.lit("Python").alias("language"), F.col("p_brand").alias("file_path"))
    return filters.narrowed(p, kind="class", language="python", prefix="BRAND#1").select("p_partkey", "p_name")


@query(f"""WITH {DIFF_SQL} SELECT path AS file_path, l.quality FROM labels l JOIN diff ON path = 'doc/' || doc_id WHERE status = 'unchanged'
UNION ALL SELECT path, -1 FROM diff WHERE status IN ('added', 'modified')""")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of unchanged files as they were, those of others made anew."""
    symbols = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("quality").cast("int").alias("quality"))
    old, new = _listings(spark, sf_dir)
    return incremental.refreshed(symbols, old, new, lambda files: files.select(F.col("path").alias("file_path"), F.lit(-1).alias("quality")))


@query("SELECT (SELECT count(*) FROM labels) AS symbol_count, count(DISTINCT doc_id) AS file_count, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.octet_length("text").alias("size_bytes"))
    return incremental.index_stats(table(spark, sf_dir, "labels"), files)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS fire_ts, count(*) AS events FROM s GROUP BY user_id, n""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), gap="30 minutes", by=["user_id"])
    return found.select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("fire_ts").cast("timestamp_ntz").alias("fire_ts"), "events")


def _folder(sf_dir: str, shelf: Shelf, spark: SparkSession) -> str:
    """A stream reads folders; documents may be one file, so they are laid out as a folder first."""
    table(spark, sf_dir, "documents").write.parquet(f"{shelf.base}/drop")
    return f"{shelf.base}/drop"


TEXTS_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_hash FROM documents"


@query(TEXTS_SQL)
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows to files of JSON lines and back, texts included; of the texts that came back the hashes."""
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    write_json(docs, f"{shelf.base}/lines")
    return _hashed(spark.read.schema(docs.schema).json(f"{shelf.base}/lines"))


@query(TEXTS_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a file stream that is read to its end into a table in the shared folder; of the texts that were written the hashes."""
    shelf = Shelf(spark)
    rows = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(_folder(sf_dir, shelf, spark))
    write = stream.writeStream.format("parquet").option("path", f"{shelf.base}/in").option("checkpointLocation", f"{shelf.base}/state")
    write.trigger(availableNow=True).start().awaitTermination()
    return _hashed(spark.read.parquet(f"{shelf.base}/in"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_hash"))
