"""Symbols from source files: one file row gives a row per declaration.

Python is parsed. Declarations of other languages are found by the language's patterns in order; a block ends where braces balance, else at the next blank
line, else at the file's end. Offsets count UTF-8 bytes.
"""

from __future__ import annotations

import ast
import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.lang import PATTERNS
from trovex.functions.text import content_hash, summary
from trovex.operators.intervals import assign_parents
from trovex.schema import ddl
from trovex.shelf import workers_find_us

_COMPILED = {lang: [(kind, re.compile(p, re.M)) for kind, p in bank] for lang, bank in PATTERNS.items()}
_MARKS = re.compile(r"[{}]")
#: A backend gives (kind, name, start, end) in characters for a source and language, or None to leave it to the patterns.
#: It may add the qualified name and the docstring.
Backend = Callable[[str, str], "list[tuple] | None"]


def parsed(source: str, language: str) -> list[tuple] | None:
    """Backend of Python sources: classes, functions, and functions within classes or functions, by the language's own parser.

    A source that doesn't parse, and every other language, is left to the patterns.
    """
    if language != "python":
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = source.splitlines(keepends=True)
    # Columns of the parser count bytes.
    place = lambda row, column: starts[row - 1] + (column if lines[row - 1].isascii() else len(lines[row - 1].encode()[:column].decode("utf-8", "replace")))
    if len(lines) != source.count("\n") + (not source.endswith("\n") and source != ""):
        return None  # line ends that the parser counts otherwise
    out: list[tuple] = []
    waiting = [(x, "") for x in reversed(tree.body)]
    while waiting:
        node, above = waiting.pop()
        below = above
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Method" if above else "Function"
            qualified = f"{above}.{node.name}" if above else node.name
            doc = (ast.get_docstring(node) or "").strip().split("\n", 1)[0]
            out.append((kind, node.name, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), qualified, doc))
            below = qualified if kind == "Class" else above
        waiting += [(x, below) for x in reversed(list(ast.iter_child_nodes(node)))]
    return out


def comment_above(source: str, start: int, language: str) -> str:
    """The first line of the comment right before a declaration, without its marks; empty if there is none."""
    marks = {"python": "#", "ruby": "#", "bash": "#", "julia": "#", "haskell": "-", "ocaml": "(*"}.get(language, "/*")
    found = ""
    for line in reversed(source[:start].rstrip(" \t").split("\n")[-31:-1]):
        line = line.strip()
        if not line.startswith(tuple(marks)):
            break
        found = line.strip(marks + "/*)! ") or found
    return found


def block_end(source: str, start: int) -> int:
    """Index after the brace that balances the first one after start; else of the next blank line; else the end."""
    depth = 0
    for m in _MARKS.finditer(source, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0 and m[0] == "}":
            return m.end()
    gap = source.find("\n\n", start)
    return len(source) if gap < 0 else gap


def first_line(text: str) -> str:
    line = text.split("\n", 1)[0].strip()
    return line[:200] + "..." if len(line) > 200 else line


def declarations(source: str, language: str, path: str, backend: Backend | None = None) -> Iterator[dict]:
    """Every declaration of a source, in the order of patterns, then of places."""
    breaks = [m.start() for m in re.finditer("\n", source)]
    wide = [i for i, c in enumerate(source) if c > "\x7f"] if not source.isascii() else []
    more = [0, *itertools.accumulate(len(source[i].encode("utf-8", "surrogatepass")) - 1 for i in wide)]
    offset = lambda i: i + more[bisect_left(wide, i)]
    line = lambda i: bisect_right(breaks, i - 1) + 1
    found = backend(source, language) if backend else None
    if found is None:
        found = [(kind, m["name"], m.start(), block_end(source, m.end())) for kind, p in _COMPILED.get(language, ()) for m in p.finditer(source)]
    classes: list[tuple[int, str]] = []
    for kind, name, start, end, *rest in found:
        at, text = line(start), source[start:end]
        above = [c for c in classes if c[0] < at]
        qualified = rest[0] if rest else f"{max(above, key=lambda c: c[0])[1]}.{name}" if above else name
        doc = rest[1] if rest and rest[1] else comment_above(source, start, language)
        if kind == "Class":
            classes.append((at, name))
        yield {
            "id": f"{path}::{qualified}#{kind.lower()}", "file_path": path, "qualified_name": qualified, "kind": kind, "name": name, "language": language,
            "signature": first_line(text), "summary": doc[:200], "byte_start": offset(start), "byte_end": offset(end), "start_line": at, "end_line": line(end),
            "content_hash": hashlib.sha256(text.encode()).hexdigest()[:16].upper(),
        }


_COLUMNS = ["repo_key", "id", "file_path", "qualified_name", "kind", "name", "language", "signature", "summary", "byte_start", "byte_end", "start_line", "end_line", "content_hash"]
_DDL = "repo_key string, id string, file_path string, qualified_name string, kind string, name string, language string, signature string, summary string, byte_start bigint, byte_end bigint, start_line int, end_line int, content_hash string"


def extract_symbols(files: DataFrame, backend: Backend | None = parsed, summarize: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """symbols of files(repo_key, path, language, content). Null contents and languages without patterns have none.

    Members get the class around them as parent. A symbol's summary is its docstring, or the first line of the comment
    above it; without one what summarize(signature, kind, qualified_name) gives, else its signature, or its kind and name.
    """
    workers_find_us(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {"repo_key": repo, **d}
                for repo, path, language, content in batch.itertuples(index=False)
                if isinstance(content, str) and isinstance(language, str)
                for d in declarations(content, language, path, backend)
            ]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    found = files.select("repo_key", "path", "language", "content").mapInPandas(run, _DDL)
    full = found.withColumns({
        "summary": summary(F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), summarize(F.col("signature"), F.col("kind"), F.col("qualified_name"))) if summarize else F.col("summary"), F.col("signature"), F.col("kind"), F.col("qualified_name")),
        "parent_id": F.lit(None).cast("string"), "references": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"), "centrality_score": F.lit(0.0),
    })
    names = [c.strip().split(" ")[0] for c in ddl("symbols").split(", ")]
    return assign_parents(full.select(*names))


def with_hash(files: DataFrame) -> DataFrame:
    """files with file_hash of their content."""
    return files.withColumn("file_hash", content_hash(F.col("content")))


def name_edges(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(src_id, dst_id) guessed from names: a symbol refers to each other symbol of its repository whose name is a word of its source. Off by default in the engine."""
    from trovex.operators.context import symbol_sources

    words = symbol_sources(symbols, sources).select("repo_key", F.col("id").alias("src_id"), F.explode(F.array_distinct(F.split(F.coalesce("source", F.lit("")), r"\W+"))).alias("name"))
    return words.join(symbols.select("repo_key", F.col("id").alias("dst_id"), "name"), ["repo_key", "name"]).where("src_id <> dst_id").select("src_id", "dst_id")
