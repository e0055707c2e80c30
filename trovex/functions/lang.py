"""Languages: extensions, declaration patterns, and detection by path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each extension; an extension belongs to one language.
EXTENSIONS: dict[str, str] = {
    e: lang
    for lang, exts in (
        ("agda", "agda"), ("bash", "bash sh"), ("c", "h c"), ("cpp", "hh cxx cc hpp cpp"), ("csharp", "cs"), ("css", "css"), ("go", "go"),
        ("haskell", "hs"), ("html", "htm html"), ("java", "java"), ("javascript", "cjs mjs jsx js"), ("json", "json"), ("julia", "jl"),
        ("ocaml", "mli ml"), ("php", "php"), ("python", "py"), ("ql", "qll ql"), ("razor", "cshtml razor"), ("ruby", "gemspec rake rb"),
        ("rust", "rs"), ("scala", "sc scala"), ("swift", "swift"), ("toml", "toml"), ("typescript", "cts mts tsx ts"), ("verilog", "svh v sv"),
    )
    for e in exts.split()
}

_NAME = r"(?P<name>\w+)"
_UPPER = r"(?P<name>[A-Z]\w*)"
_LOWER = r"(?P<name>[a-z]\w*)"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _seen(words: str) -> str:
    """One of the words and a gap, or nothing."""
    return "(?:" + "|".join(w + r"\s+" for w in words.split()) + ")?"


_OPEN = _any("internal private protected public")
_SCRIPT = [("Function", r"(?:^|\s)function\s+" + _NAME + r"\s*\("), ("Class", r"^class\s+" + _NAME), ("Method", r"^\s+" + _NAME + r"\s*\([^)]*\)\s*\{")]
_MANAGED = [
    ("Class", _OPEN + r"?\s*" + _any("abstract sealed") + r"?\s*class\s+" + _NAME),
    ("Method", _OPEN + r"\s+(?:static\s+)?(?:async\s+)?[\w<>\[\]]+\s+" + _NAME + r"\s*\("),
]
_NATIVE = [("Function", r"^[\w*]+\s+" + _NAME + r"\s*\([^)]*\)\s*\{"), ("Type", r"^(?:typedef\s+)?" + _any("struct enum union") + r"\s+" + _NAME)]
#: Declarations of each language as (kind, pattern), looked for in this order. Patterns hold in multi-line mode.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "python": [("Function", r"^def\s+" + _NAME + r"\s*\("), ("Class", r"^class\s+" + _NAME)],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": [("Function", r"^func\s+" + _NAME + r"\s*\("), ("Method", r"^func\s+\([^)]+\)\s+" + _NAME + r"\s*\(")],
    "rust": [("Function", "^" + _seen("pub") + r"fn\s+" + _NAME + r"\s*[<(]"), ("Type", "^" + _seen("pub") + _any("struct enum trait") + r"\s+" + _NAME)],
    "java": _MANAGED,
    "csharp": _MANAGED,
    "c": _NATIVE,
    "cpp": _NATIVE,
    "ruby": [("Function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"), ("Class", r"^\s*class\s+" + _UPPER), ("Module", r"^\s*module\s+" + _UPPER)],
    "swift": [
        ("Function", r"^\s*" + _seen("public private internal") + r"func\s+" + _NAME),
        ("Class", r"^\s*" + _seen("public private") + r"class\s+" + _NAME),
        ("Type", r"^\s*" + _seen("public private") + _any("struct protocol") + r"\s+" + _NAME),
        ("Enum", r"^\s*" + _seen("public private") + r"enum\s+" + _NAME),
    ],
    "scala": [("Function", r"^\s*def\s+" + _NAME), ("Class", r"^\s*" + _seen("case") + _any("class object") + r"\s+" + _NAME), ("Type", r"^\s*trait\s+" + _NAME)],
    "haskell": [("Function", "^" + _LOWER + r"\s+::"), ("Type", "^" + _any("data newtype type") + r"\s+" + _UPPER), ("Class", r"^class\s+" + _UPPER)],
    "julia": [("Function", r"^\s*function\s+" + _NAME), ("Type", r"^\s*" + _seen("mutable") + r"struct\s+" + _NAME), ("Module", r"^\s*module\s+" + _NAME)],
    "ocaml": [("Function", r"^let\s+" + _seen("rec") + _NAME), ("Type", r"^type\s+" + _NAME), ("Module", r"^module\s+" + _UPPER)],
    "bash": [("Function", "^" + _seen("function") + _NAME + r"\s*\(\s*\)")],
}


def extension(path: Column) -> Column:
    """Lower-case extension of a path without its dot; empty if the file name has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path: Column, extensions: Mapping[str, str] = EXTENSIONS) -> Column:
    """Language of a path by its extension, null if unknown: a map literal, no join."""
    table = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.try_element_at(table, extension(path))


def languages(extensions: Mapping[str, str] = EXTENSIONS) -> list[str]:
    return sorted(set(extensions.values()))


def language_sql(path: str, extensions: Mapping[str, str] = EXTENSIONS) -> str:
    pairs = ", ".join(f"'{k}': '{v}'" for k, v in extensions.items())
    return f"map_extract_value(MAP {{{pairs}}}, lower(regexp_extract({path}, '\\.([^./\\\\]+)$', 1)))"
