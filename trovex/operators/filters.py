"""Which files are indexed and which symbols are looked at: boolean columns that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovex.functions.lang import extension, language_of
from trovex.schema import KINDS

#: File name endings that mark binaries, by sort of file.
BINARY = frozenset(
    "pyc pyo class o a so dylib dll exe bin wasm"  # compiled
    " bmp gif ico jpeg jpg png svg webp"  # pictures
    " mp3 mp4 ogg wav"  # sound and film
    " 7z bz2 gz rar tar zip"  # archives
    " doc docx pdf ppt pptx xls xlsx"  # office
    " eot ttf woff woff2"  # fonts
    " db mdf sqlite".split()
)
SECRET_ENDINGS = frozenset("jks keystore p12 pfx key pem der crt cert".split())
SECRET_NAMES = frozenset({f"id_{k}" for k in ("ecdsa", "ed25519", "rsa")} | {f".env{s}" for s in ("", ".local", ".staging", ".production")} | {"secrets.json", "appsettings.secrets.json"})
SKIPPED = frozenset({".git", ".hg", ".svn"} | {".idea", ".vs", ".vscode"} | {"node_modules", "packages", "vendor"} | {"__pycache__", ".pytest_cache"} | {"bin", "build", "dist", "obj", "out"})


def _base(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def is_binary(path: Column) -> Column:
    return extension(path).isin(sorted(BINARY))


def is_secret(path: Column) -> Column:
    return _base(path).isin(sorted(SECRET_NAMES)) | extension(path).isin(sorted(SECRET_ENDINGS))


def in_skipped_dir(path: Column) -> Column:
    """Any segment of the path, its file name too, is a skipped name."""
    segments = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in sorted(SKIPPED)]))


def climbs(path: Column) -> Column:
    return path.contains("..")


def should_index(path: Column, size: Column, max_bytes: int = 1_000_000, ignored: Sequence[str] = ()) -> Column:
    """Small enough, and neither binary, secret, in a skipped folder, climbing, nor ignored. The path is relative to its root."""
    return (size <= max_bytes) & ~is_binary(path) & ~is_secret(path) & ~in_skipped_dir(path) & ~climbs(path) & ~matches_ignore(path, ignored)


def ignore_rules(text: str) -> list[str]:
    """The patterns of an ignore file: trimmed lines that are neither blank nor comments."""
    return [x for x in (line.strip() for line in text.splitlines()) if x and not x.startswith("#")]


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", j + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def ignore_regex(pattern: str) -> str:
    """Regular expression of one ignore pattern, without its !, over relative paths with slashes."""
    folder, p = pattern.endswith("/"), pattern.rstrip("/")
    anchored = "/" in p
    return ("^" if anchored else "(?:^|/)") + _glob(p.lstrip("/")) + ("/" if folder else "(?:/|$)")


def matches_ignore(path: Column, rules: Iterable[str]) -> Column:
    """Whether the last rule that matches ignores the path; rules that begin with ! take back."""
    out = F.lit(False)
    for rule in rules:
        back = rule.startswith("!")
        out = F.when(path.rlike(ignore_regex(rule[back:])), F.lit(not back)).otherwise(out)
    return out


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """files with a column language; those of unknown language go."""
    return files.withColumn("language", language_of(F.col(path))).where("language is not null")


def parse_kind(kind: str | None) -> str | None:
    """The kind's name whatever its case; an unknown one raises."""
    if kind is None:
        return None
    for k in KINDS:
        if k.lower() == kind.lower():
            return k
    raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")


def narrowed(symbols: DataFrame, kind: str | None = None, language: str | None = None, prefix: str | None = None) -> DataFrame:
    """symbols of a kind, a language (case aside) and a path prefix (case aside); None takes all."""
    if kind is not None:
        symbols = symbols.where(F.col("kind") == parse_kind(kind))
    if language is not None:
        symbols = symbols.where(F.lower("language") == language.lower())
    if prefix is not None:
        symbols = symbols.where(F.startswith(F.lower(F.col("file_path")), F.lit(prefix.lower())))
    return symbols


def resolve_repo(keys: Sequence[str], given: str | None = None, folder: str | None = None) -> str:
    """Key of a repository: the given one, else the one named like the folder, else the only one."""
    if given and given.strip():
        return given.strip()
    for k in keys:
        if folder and k.lower() == folder.lower():
            return k
    if len(keys) == 1:
        return keys[0]
    raise LookupError("name a repository; there are: " + (", ".join(sorted(keys)) or "none"))
