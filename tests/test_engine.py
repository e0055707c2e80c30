import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from trovex import cli
from trovex.engine import Engine
from trovex.operators import filters
from trovex.operators.extract import declarations, parsed
from trovex.schema import Options
from trovex.sources import folder, remote
from trovex.sources.store import Store
from trovex.streaming.watch import FolderWatcher, sessions

FILES = {
    "models/user.py": 'class User:\n    """A user."""\n\ndef get_by_id(key):\n    return key\n',
    "services/order.cs": "public class OrderService\n{\n    public void PlaceOrder(int id)\n    {\n    }\n}\n",
    "scripts/tool.py": "def load_data(path):\n    return path\n\ndef summarize(rows):\n    return len(rows)\n",
    "secrets.json": "{}", "data.exe": "x", "cert.pem": "x", "bin/app.py": "def hidden(): pass\n", "readme.txt": "no",
}


class Fake:
    """A host with one repository."""

    def exists(self, repo):
        return repo == "own/repo"

    def files(self, repo):
        return [(p, len(t), "s") for p, t in FILES.items()] + [("big.py", 2_000_000, "s")]

    def content(self, repo, path):
        return FILES[path]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "shop"
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Options(index_path=str(tmp_path / "index")), client="tests.test_engine:Fake")


def test_folder_life(engine, repo, spark):
    meta = engine.index_folder(str(repo))
    assert (meta["repo_key"], meta["file_count"], meta["is_local"]) == ("shop", 3, True)
    names = {r.name for r in engine.repo_outline("shop").collect()}
    assert {"User", "get_by_id", "OrderService", "PlaceOrder", "load_data", "summarize"} <= names
    assert engine.search_symbols("shop", "load data").first().name == "load_data"
    assert engine.search_symbols("shop", "order", kind="Class").first().name == "OrderService"
    assert [r.file_path for r in engine.search_text("shop", "rows").collect()][0] == "scripts/tool.py"
    assert engine.symbol_source("shop", "scripts/tool.py::load_data#function").startswith("def load_data(path):")
    assert engine.symbol_source("shop", "none") is None
    assert engine.ranked_context("shop", "load data", 4000).first().used_tokens > 0
    assert [r.path for r in engine.file_tree("shop", "MODELS").collect()] == ["models/user.py"]
    assert {r.id for r in engine.file_outline("shop", "models/user.py").collect()} == {"models/user.py::User#class", "models/user.py::get_by_id#function"}
    assert engine.importance("shop", 2).count() == 2
    assert "OrderService" not in {r.name for r in engine.dead_code("shop").collect()}
    assert engine.blast_radius("shop", "none").count() == 0
    assert [r.id for r in engine.symbols_with_source("shop", ["scripts/tool.py::summarize#function", "x"]).collect()] == ["scripts/tool.py::summarize#function"]

    (repo / "scripts/tool.py").write_text("def fibonacci(n):\n    return n\n")
    (repo / "models/user.py").unlink()
    (repo / "models/extra.py").write_text("def extra():\n    pass\n")
    engine.reindex("shop")
    names = {r.name for r in engine.repo_outline("shop").collect()}
    assert {"fibonacci", "extra", "PlaceOrder"} <= names and not {"load_data", "User"} & names
    (repo / ".gitignore").write_text("# none\n\nscripts/\n")
    assert engine.index_folder(str(repo))["file_count"] == 2
    assert engine.repos() == ["shop"] and engine.resolve() == "shop"
    assert engine.store.raw_source("shop", "models/extra.py") == "def extra():\n    pass\n" and engine.store.raw_source("shop", "x") is None
    assert engine.invalidate("shop") and not engine.invalidate("shop") and engine.repos() == []
    with pytest.raises(LookupError):
        engine.search_symbols("shop", "x")


def test_remote(engine):
    meta = engine.index_repo("own/repo")
    assert meta["file_count"] == 3 and not meta["is_local"] and engine.repos() == ["own/repo"]
    assert engine.search_symbols("own/repo", "summarize").first().name == "summarize"
    assert {r.path: r.content for r in remote.scan_repository(engine.spark, "own/repo", engine.client).collect()} == {p: FILES[p] for p in ("models/user.py", "services/order.cs", "scripts/tool.py")}
    with pytest.raises(FileNotFoundError):
        engine.index_repo("no/repo")
    with pytest.raises(LookupError):
        engine.changed_symbols("own/repo", "a", "b")
    assert remote.client_of("tests.test_engine:Fake").exists("own/repo")


def test_changed_symbols_from_git(engine, repo):
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (repo / "scripts/tool.py").write_text("def load_data(p):\n    return p\n")
    git("commit", "-qam", "two")
    engine.index_folder(str(repo))
    assert {(r.name, r.change) for r in engine.changed_symbols("shop", "HEAD~1", "HEAD").collect()} == {("load_data", "modified")}
    with pytest.raises(subprocess.CalledProcessError):
        engine.changed_symbols("shop", "nope", "HEAD")


def test_guessed_edges_and_summaries(spark, tmp_path, repo):
    (repo / "scripts/tool.py").write_text("def load_data(path):\n    return path\n\ndef run():\n    return load_data(1)\n")
    e = Engine(spark, Options(index_path=str(tmp_path / "i")), guess_edges=True, summarize=lambda s, k, q: F.concat(F.lit("a "), k))
    e.index_folder(str(repo))
    assert {r.name for r in e.blast_radius("shop", "scripts/tool.py::load_data#function").collect()} == {"run"}
    assert e.search_symbols("shop", "run").first().summary == "a Function"


def test_command_line(spark, repo, tmp_path, capsys):
    at = ["--index-path", str(tmp_path / "i")]
    say = lambda *a: (cli.main([*at, *a]), capsys.readouterr().out)
    assert say("index", "folder", str(repo))[1].startswith("shop: ")
    assert cli.main([*at, "index", "folder", str(tmp_path / "none")]) == 1
    assert json.loads(say("search", "symbols", "summarize", "--json")[1].splitlines()[0])["name"] == "summarize"
    assert "tool.py" in say("search", "text", "rows")[1]
    assert say("get", "symbol", "scripts/tool.py::load_data#function")[1].startswith("def load_data")
    assert cli.main([*at, "get", "symbol", "x"]) == 1
    assert json.loads(say("get", "context", "load data", "--json")[1])["budget_tokens"] == 4000
    for a in (["outline", "repo", "shop"], ["outline", "file", "shop", "scripts/tool.py"], ["analyze", "importance", "shop"], ["analyze", "dead-code", "shop"], ["list"]):
        code, out = say(*a)
        assert code == 0 and out
    assert say("analyze", "blast-radius", "shop", "x", "--depth", "2") == (0, "")
    assert cli.main([*at, "search", "symbols", "x", "--kind", "nonsense"]) == 1
    assert say("invalidate", "shop")[1] == "removed\n"


def test_store_replaces_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    edge = lambda x: {"edges": spark.createDataFrame([(x, x)], "src_id string, dst_id string")}
    assert store.load("a/b") is None and store.keys() == []
    for x in "123":
        store.save("a/b", edge(x))
    store.save("a__b", edge("9"))
    assert store.keys() == ["a/b", "a__b"] and store.load("a/b")["edges"].first().src_id == "3"
    (tmp_path / "s" / "a__b" / "current.json").write_text("{broken")
    (tmp_path / "s" / "a__b" / ".current.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        store.load("a__b")


@pytest.mark.parametrize("path", ["../x", "/etc/passwd", "a/../../x", "C:\\x"])
def test_paths_stay_inside(path):
    with pytest.raises(PermissionError):
        folder.safe_path(path)


def test_read_and_exists(spark, repo):
    assert folder.read_file(spark, str(repo), "scripts/tool.py") == FILES["scripts/tool.py"]
    assert folder.exists(spark, str(repo)) and not folder.exists(spark, str(repo / "none"))
    assert folder.scan_folder(spark, str(repo), Options(max_files=1)).count() == 1
    with pytest.raises(FileNotFoundError):
        folder.scan_folder(spark, str(repo / "none"))


ALLOWED = ["src/main.py", "README.py", "a/b/c.ts", "lib.rs"]
REFUSED = [".env", "config/.env.local", "secrets.json", "key.pem", "id_rsa", "a.exe", "b.DLL", "c.png", "d.zip", "e.pyc", "node_modules/x.js", ".git/config.py", "a/bin/b.py", "obj/x.cs", "Vendor/y.go", "dist/z.js", "a/../b.py", "a..b.py"]


def test_filter_table(spark):
    df = spark.createDataFrame([(p, 10) for p in ALLOWED + REFUSED] + [("at.py", 1_000_000), ("over.py", 1_000_001)], "path string, size bigint")
    assert {r.path for r in df.where(filters.should_index(F.col("path"), F.col("size"))).collect()} == {*ALLOWED, "at.py"}


def test_ignore_rules(spark):
    rules = filters.ignore_rules("*.log\nbuild/\n# comment\n\n*.tmp\n*.generated.cs\n/only/root.py\n!keep.log\ndocs/**/x.py\n")
    assert len(rules) == 7
    paths = {"a.log": True, "d/b.log": True, "keep.log": False, "build/x.py": True, "q/build/x.py": True, "x.generated.cs": True, "x.cs": False, "only/root.py": True, "a/only/root.py": False, "docs/x.py": True, "docs/a/b/x.py": True, "comment": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.y for r in df.select("path", filters.matches_ignore(F.col("path"), rules).alias("y")).collect()} == paths


def test_resolve():
    assert filters.resolve_repo(["a", "b"], " a ") == "a" and filters.resolve_repo(["Shop", "b"], None, "shop") == "Shop" and filters.resolve_repo(["a"]) == "a"
    with pytest.raises(LookupError):
        filters.resolve_repo(["a", "b"])


@pytest.mark.parametrize("language, text, want", [
    ("python", "def f(x):\n    pass\n\nclass A:\n    def m(self): pass\n", {("Function", "f"), ("Class", "A")}), ("python", "", set()), ("python", "# only\n", set()),
    ("typescript", "class Foo {\n  bar(x) {\n  }\n}\n", {("Class", "Foo"), ("Method", "bar")}), ("ruby", "class A\n  def go?\n  end\nend\n", {("Class", "A"), ("Function", "go?")}),
    ("swift", "public func go() {}\nstruct P {}\n", {("Function", "go"), ("Type", "P")}), ("scala", "case class A()\ntrait T\n", {("Class", "A"), ("Type", "T")}), ("haskell", "area :: Int\ndata Shape = A\n", {("Function", "area"), ("Type", "Shape")}),
    ("julia", "function f(x)\nend\nmutable struct S\nend\n", {("Function", "f"), ("Type", "S")}), ("ocaml", "let rec f x = x\nmodule M = struct end\n", {("Function", "f"), ("Module", "M")}), ("c", "int main(void) {\n}\nstruct s { int x; };\n", {("Function", "main"), ("Type", "s")}), ("unknown", "def f(): pass", set()),
])
def test_declarations(language, text, want):
    assert {(d["kind"], d["name"]) for d in declarations(text, language, "f")} == want


def test_backend_can_replace_patterns():
    assert [d["name"] for d in declarations("abc", "x", "f", lambda s, lang: [("Function", "q", 0, 3)])] == ["q"]


def test_watcher_refreshes_once_per_burst(spark, repo, tmp_path):
    seen = []
    w = FolderWatcher(spark, str(repo), seen.append, str(tmp_path / "state"))
    assert w.poll(1, 0.0)["added"] == 7 and seen == []  # what is in bin isn't listed
    assert w.poll(2, 3.0) == {} and seen == [2] and w.poll(3, 9.0) == {} and seen == [2]
    (repo / "new.py").write_text("def x(): pass\n")
    assert w.poll(4, 10.0) == {"added": 1}
    (repo / "new.py").write_text("def x(): return 1\n")
    assert w.poll(5, 11.0) == {"modified": 1} and w.poll(6, 12.5) == {} and seen == [2]  # not quiet for long enough
    assert w.poll(7, 13.0) == {} and seen == [2, 7]
    (repo / "new.py").rename(repo / "models" / "newer.py")
    (repo / "readme.txt").unlink()
    assert w.poll(8, 20.0) == {"added": 1, "deleted": 2}
    w.stop()
    again = FolderWatcher(spark, str(repo), seen.append, str(tmp_path / "state"))  # it knows the listing of the last refresh
    assert again.poll(9, 0.0) == {"added": 1, "deleted": 2} and again.poll(10, 2.0) == {} and seen == [2, 7, 10]


def test_watcher_as_a_stream(spark, repo, tmp_path):
    seen = []
    w = FolderWatcher(spark, str(repo), seen.append, str(tmp_path / "state"), quiet=0.2)
    assert w.start() is w.start()
    until = time.time() + 60
    while not seen and time.time() < until:
        time.sleep(0.2)
    w.stop()
    assert len(seen) == 1 and not w.query.isActive


def test_names_that_spark_hides(spark, repo):
    for p in ("pkg/__init__.py", "_priv/x.py", ".hidden/y.py", "a b/z 1.py", "node_modules/n.py"):
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(f"# {p} \u00e9\ndef f(): pass\n")
    (repo / ".gitignore").write_text("scripts/\n")
    got = {r.path: r.content for r in folder.scan_folder(spark, str(repo)).collect()}
    assert set(got) == {"models/user.py", "services/order.cs", "pkg/__init__.py", "_priv/x.py", ".hidden/y.py", "a b/z 1.py"}
    assert got["a b/z 1.py"] == "# a b/z 1.py \u00e9\ndef f(): pass\n"


def test_parts_can_be_replaced(spark, repo, tmp_path):
    only = lambda path, size, most, rules: path.startswith("readme")
    e = Engine(spark, Options(index_path=str(tmp_path / "i")), security=only, extensions={"txt": "python"}, backend=lambda s, lang: [("Function", "word", 0, len(s))])
    assert e.index_folder(str(repo))["file_count"] == 1 and e.search_symbols("shop", "word").first().language == "python"


def test_python_is_parsed():
    text = 'X = "é"\n\n\nclass A(B):\n    """Says what.\n\n    More."""\n\n    x = 1\n\n    async def m(self):\n        def inner(): pass\n\n\n# Adds one.\ndef f(x):\n\n    return x\n'
    got = [(d["kind"], d["qualified_name"], d["start_line"], d["end_line"], d["summary"]) for d in declarations(text, "python", "p.py", parsed)]
    assert got == [("Class", "A", 4, 12, "Says what."), ("Method", "A.m", 11, 12, ""), ("Method", "A.inner", 12, 12, ""), ("Function", "f", 16, 18, "Adds one.")]
    f = list(declarations(text, "python", "p.py", parsed))[-1]
    assert text.encode()[f["byte_start"] : f["byte_end"]].decode() == "def f(x):\n\n    return x" and f["signature"] == "def f(x):"
    assert [d["name"] for d in declarations("def ok(:\n", "python", "p")] == ["ok"] == [d["name"] for d in declarations("def ok(:\n", "python", "p", parsed)]
    assert [d["summary"] for d in declarations("/**\n * Goes.\n * Far.\n */\npublic class Go\n{\n}\n", "csharp", "g.cs")] == ["Goes."]


def test_sessions_fire_after_quiet(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",), ("2024-01-01 00:00:10",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sorted((str(r.fire_ts), r.events) for r in sessions(df).collect()) == [("2024-01-01 00:00:03", 2), ("2024-01-01 00:00:12", 1)]
