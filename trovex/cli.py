"""Command line: python -m trovex.cli COMMAND ... [--json]."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from trovex.engine import Engine
from trovex.schema import Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trovex")
    p.add_argument("--index-path")
    groups = p.add_subparsers(dest="group", required=True)

    def add(parent: argparse._SubParsersAction, name: str, *args: str, **options: object) -> argparse.ArgumentParser:
        c = parent.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k, default=v, type=type(v) if v is not None else str)
        c.add_argument("--json", action="store_true")
        return c

    def group(name: str) -> argparse._SubParsersAction:
        return groups.add_parser(name).add_subparsers(dest="command", required=True)

    g = group("index")
    add(g, "repo", "name")
    add(g, "folder", "path")
    g = group("search")
    add(g, "symbols", "query", repo=None, kind=None, language=None, top=10)
    add(g, "text", "query", repo=None, top=10)
    g = group("get")
    add(g, "symbol", "id", repo=None)
    add(g, "context", "query", repo=None, budget=4000)
    g = group("outline")
    add(g, "repo", "repo")
    add(g, "file", "repo", "path")
    g = group("analyze")
    add(g, "importance", "repo", top=20)
    add(g, "dead-code", "repo", top=20)
    add(g, "blast-radius", "repo", "id", depth=3)
    add(g, "changes", "repo", "old", "new")
    add(groups, "list")
    add(groups, "invalidate", "repo")
    return p


_FIELDS = {
    "symbols": ["id", "name", "kind", "file_path", "summary", "score", "match_type"], "text": ["id", "name", "kind", "file_path", "score"],
    "repo": ["id", "name", "kind", "file_path", "start_line", "end_line", "depth", "parent_id"], "file": ["id", "name", "kind", "start_line", "end_line", "depth", "parent_id"],
    "importance": ["id", "name", "kind", "file_path", "score"], "dead-code": ["id", "name", "kind", "file_path", "reason"], "blast-radius": ["id", "name", "kind", "file_path", "depth"], "changes": ["id", "name", "kind", "file_path", "change"],
}


def show(rows: DataFrame, fields: list[str], as_json: bool, most: int | None = None, numbered: bool = False) -> None:
    rows = rows.select(*fields)
    if as_json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
        return
    for n, r in enumerate((rows.limit(most) if most else rows).toLocalIterator(), 1):
        print((f"{n}\t" if numbered else "") + "\t".join("" if v is None else (s[:59] + "…" if len(s := str(v)) > 60 else s) for v in r))


def run(engine: Engine, a: argparse.Namespace) -> int:
    at = os.path.basename(os.getcwd())
    name = getattr(a, "command", None)
    if a.group == "index":
        if name == "folder" and not os.path.isdir(a.path):
            print(f"no such folder: {a.path}", file=sys.stderr)
            return 1
        meta = engine.index_folder(a.path) if name == "folder" else engine.index_repo(a.name)
        print(json.dumps(meta, default=str) if a.json else f"{meta['repo_key']}: {meta['symbol_count']} symbols in {meta['file_count']} files")
    elif a.group == "list":
        print(json.dumps(engine.repos()) if a.json else "\n".join(engine.repos()))
    elif a.group == "invalidate":
        print("removed" if engine.invalidate(a.repo) else "there was no index")
    elif a.group == "search":
        repo = engine.resolve(a.repo, at)
        found = engine.search_symbols(repo, a.query, a.kind, a.language, a.top) if name == "symbols" else engine.search_text(repo, a.query, a.top)
        show(found, _FIELDS[name], a.json)
    elif a.group == "get":
        repo = engine.resolve(a.repo, at)
        if name == "symbol":
            source = engine.symbol_source(repo, a.id)
            if source is None:
                print("no such symbol", file=sys.stderr)
                return 1
            print(json.dumps({"id": a.id, "source": source}) if a.json else source)
        else:
            row = engine.ranked_context(repo, a.query, a.budget).first().asDict(recursive=True)
            if a.json:
                print(json.dumps(row))
            else:
                print(f"{row['used_tokens']} of {row['budget_tokens']} tokens, {row['excluded_count']} left out")
                for s in row["symbols"]:
                    print(f"\n# {s['id']}\n{s['source']}")
    elif a.group == "outline":
        show(engine.repo_outline(a.repo) if name == "repo" else engine.file_outline(a.repo, a.path), _FIELDS[name], a.json)
    elif name == "importance":
        show(engine.importance(a.repo, a.top), _FIELDS[name], a.json, numbered=True)
    elif name == "dead-code":
        dead = engine.dead_code(a.repo)
        show(dead, _FIELDS[name], a.json, a.top)
        if not a.json:
            print(f"{dead.count()} in all")
    elif name == "blast-radius":
        show(engine.blast_radius(a.repo, a.id, a.depth), _FIELDS[name], a.json)
    else:
        show(engine.changed_symbols(a.repo, a.old, a.new), _FIELDS[name], a.json)
    return 0


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("trovex").getOrCreate()
    options = Options(index_path=a.index_path) if a.index_path else Options()
    try:
        return run(Engine(spark, options), a)
    except (LookupError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
