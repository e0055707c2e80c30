import duckdb
import pytest
from pyspark.sql import functions as F

from trovex.operators import graph, incremental, intervals, outline
from trovex.plans import catalogue


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src_id string, dst_id string")


def nodes(spark, names, kind="Function"):
    return spark.createDataFrame([(n, kind) for n in names], "id string, kind string")


def brute(names, pairs, rounds=100):
    n, pairs = len(names), [(a, b) for a, b in pairs if a in names and b in names]
    deg = {x: sum(a == x for a, _ in pairs) for x in names}
    r = dict.fromkeys(names, 1 / n)
    for _ in range(rounds):
        lost = sum(r[x] for x in names if not deg[x])
        new = {x: 0.15 / n + 0.85 * (lost / n + sum(r[a] / deg[a] for a, b in pairs if b == x)) for x in names}
        moved = sum(abs(new[x] - r[x]) for x in names)
        r = new
        if moved < 1e-6:
            break
    top = max(r.values())
    return {x: v / top for x, v in r.items()}


@pytest.mark.parametrize("names, pairs", [("abcd", ["ab", "bc", "cd"]), ("abcu", ["au", "bu", "cu"]), ("abc", ["ab", "ab", "ac", "ba", "xz"]), ("a", [])])
def test_pagerank_against_plain_loop(spark, names, pairs):
    got = {r.id: r["rank"] for r in graph.pagerank(nodes(spark, names), edges(spark, [tuple(p) for p in pairs])).collect()}
    want = brute(list(names), [tuple(p) for p in pairs])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert max(got.values()) == pytest.approx(1.0)


def test_whole_pagerank_takes_all_edges_to_the_tolerance(spark, tmp_path):
    # Low quantities throughout, many rounds to the tolerance (the cycles 1-2 and 3-4-5), 8 and 9 end orders alone, 10 is in none.
    orders = [[1, 2, 1, 2, 1], [3, 4, 5, 3], [2, 8], [6, 3, 9], [7, 6, 99, 1], [4, 9]]
    lines = [(o, n, p, 1, 50.0 if (o + n) % 4 == 0 else 3.0) for o, ps in enumerate(orders) for n, p in enumerate(ps)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 11)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    want = brute(list(range(1, 11)), [e for ps in orders for e in zip(ps, ps[1:])])
    got = {r.id: r["rank"] for r in catalogue.pagerank(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    best = catalogue.importance_topk(spark, str(tmp_path)).collect()
    assert [r.id for r in best] == sorted(want, key=lambda k: (-round(want[k], 9), k)) and all(r.score == got[r.id] for r in best)


@pytest.mark.parametrize("block", [1, 3, graph.BLOCK])
def test_pagerank_by_blocks_shuffles_no_link_in_a_round(spark, tmp_path, monkeypatch, block):
    made = []
    keep = graph.Shelf.keep
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph.Shelf, "keep", lambda self, df, *more, **how: made.append((df._jdf.queryExecution().optimizedPlan().toString(), how)) or keep(self, df, *more, **how))
    pairs = [(i, (i * i + 3 * k) % 41) for i in range(40) if i % 7 for k in range(1 + i % 9)] + [(3, 5)] * 4 + [(5, None), (None, 5)]
    df = spark.createDataFrame([(i,) for i in range(40)], "id bigint")
    got = {r.id: r["rank"] for r in graph.pagerank(df, spark.createDataFrame(pairs, "src_id bigint, dst_id bigint")).collect()}
    want = brute(list(range(40)), pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # a round reads links where they lie: the only joins are those of a row per node
    rounds = [plan for plan, how in made if how][1:]
    assert len(rounds) > 3 and all("MapInArrow" in plan and not any("Join" in line and "src" in line for line in plan.splitlines()) for plan in rounds)


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(nodes(spark, ""), edges(spark, [])).count() == 0


def test_dead(spark):
    df = nodes(spark, ["truly_dead", "alive", "other", "caller"]).union(nodes(spark, ["Model"], "Class"))
    dead = {r.id for r in graph.dead_symbols(df, edges(spark, [("alive", "other"), ("caller", "alive"), ("x", "nowhere")])).collect()}
    assert dead == {"truly_dead", "caller"}


def test_whole_dead_takes_all_lines(spark, tmp_path):
    lines = [(1, 1, "N", 3.0), (1, 2, "R", 50.0), (2, 3, "R", 10.0), (3, None, "A", 50.0), (3, 9, "A", 50.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_returnflag string, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"part {i}") for i in range(1, 6)], "p_partkey bigint, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalogue.dead_parts(spark, str(tmp_path)).collect()))
    assert got == [(4, "part 4", graph.DEAD_REASON), (5, "part 5", graph.DEAD_REASON)]
    db = duckdb.connect()
    for t in ("lineitem", "part"):
        db.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(db.sql(f"SELECT p_partkey, p_name, '{graph.DEAD_REASON}' FROM part WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_partkey = p_partkey)").fetchall()) == got


def test_blast_radius(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "core"), ("core", "a"), ("ghost", "core")])
    at = lambda d: {r.id: r.depth for r in graph.blast_radius(e, "core", d).collect()}
    assert at(1) == {"d": 1, "ghost": 1}
    assert at(4) == {"d": 1, "ghost": 1, "c": 2, "b": 3, "a": 4}
    assert at(9) == at(4)
    assert graph.blast_radius(e, "unknown").count() == 0


def test_importance(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 1.0), ("c", 0.2)], "id string, centrality_score double")
    assert [r.id for r in graph.importance(df, 2).collect()] == ["b", "a"]


def test_changes(spark):
    df = spark.createDataFrame([("x.py", 1), ("y.py", 2), ("z.py", 3), ("w.py", 4)], "file_path string, n int")
    ch = spark.createDataFrame([("x.py", "Added"), ("y.py", "Renamed"), ("z.py", "D")], "path string, status string")
    assert {r.n: r.change for r in graph.changed_symbols(df, ch).collect()} == {1: "added", 2: "modified", 3: "deleted"}


def test_outline(spark):
    rows = [("MyClass", None, 1), ("do_work", "MyClass", 5), ("cleanup", "MyClass", 12), ("main", None, 22), ("main", None, 30), ("lost", "elsewhere", 40)]
    got = {r.id: r for r in outline.outline(spark.createDataFrame(rows, "id string, parent_id string, start_line int")).collect()}
    assert {i for i, r in got.items() if r.depth == 0} == {"MyClass", "main", "lost"}
    assert got["MyClass"].child_count == 2 and got["do_work"].path == ["MyClass", "do_work"] and got["main"].start_line == 22


def test_outline_of_long_chains_and_loops(spark):
    rows = [(f"a{i}", f"a{i - 1}", i) for i in range(700)] + [(f"b{i}", f"b{i - 1}", i) for i in range(64, 129)]
    rows += [("x", "z", 1), ("y", "x", 2), ("z", "y", 3), ("under", "x", 4), ("self", "self", 5)]
    got = {r.id: r for r in outline.outline(spark.createDataFrame(rows, "id string, parent_id string, start_line int")).collect()}
    assert {i: (r.root_id, r.depth, r.child_count) for i, r in got.items()} == {f"a{i}": ("a0", i, int(i < 699)) for i in range(700)} | {f"b{i}": ("b64", i - 64, int(i < 128)) for i in range(64, 129)}
    assert got["a699"].path == [f"a{i}" for i in range(700)]


def test_file_tree(spark):
    df = spark.createDataFrame([("src/b.py",), ("SRC/a.py",), ("lib/c.py",), ("src/b.py",)], "path string")
    assert [r.path for r in outline.file_tree(df, "Src").collect()] == ["SRC/a.py", "src/b.py"]


def test_parents_are_innermost(spark):
    rows = [("r", "f.py", "A", "Class", 1, 50, None), ("r", "f.py", "B", "Class", 10, 30, None), ("r", "f.py", "m", "Method", 12, 15, None), ("r", "f.py", "n", "Method", 40, 45, None), ("r", "g.py", "o", "Method", 12, 15, None), ("r", "f.py", "p", "Field", 2, 2, "given")]
    df = spark.createDataFrame(rows, "repo_key string, file_path string, id string, kind string, start_line int, end_line int, parent_id string")
    got = {r.id: r.parent_id for r in intervals.assign_parents(df).collect()}
    assert got == {"A": None, "B": None, "m": "B", "n": "A", "o": None, "p": "given"}


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, file_hash string")
    assert {r.path: r.status for r in incremental.manifest_diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "unchanged", "d": "deleted", "e": "added"}


def test_edges_of(spark):
    df = spark.createDataFrame([("a", ["b", "b"]), ("c", [])], "id string, references array<string>")
    assert sorted(map(tuple, graph.edges_of(df).collect())) == [("a", "b"), ("a", "b")]
    _ = F
