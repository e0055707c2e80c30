"""Scalar expressions on text, all on the JVM side: tokens, hashes, identifiers, signatures and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the search tokenizer cuts; DuckDB reads it alike.
SEPARATORS = r"[ _\-./(){}\n\r\t:]+"


def tokens(text: Column) -> Column:
    """Lower-case search tokens of two characters or more; a null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda t: F.char_length(t) > 1)


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{SEPARATORS}'), lambda t: length(t) > 1)"


def query_tokens(query: str) -> list[str]:
    """The tokens of a query on the driver, in order, repeats included."""
    import re

    return [t for t in re.split(SEPARATORS, query.lower()) if len(t) > 1]


def search_text(name: Column, qualified: Column, summary: Column, keywords: Column | None = None) -> Column:
    """What a symbol is found by; a name counts again in its qualified name."""
    parts = [name, qualified, summary]
    return F.concat_ws(" ", *parts, F.concat_ws(" ", keywords)) if keywords is not None else F.concat_ws(" ", *parts)


def content_hash(text: Column) -> Column:
    """First 16 upper-case hex digits of the text's SHA-256."""
    return F.upper(F.left(F.sha2(text.cast("binary"), 256), F.lit(16)))


def token_estimate(start: Column, end: Column) -> Column:
    """Bytes over four, cut."""
    return F.floor((end - start) / 4).cast("int")


def symbol_id(path: Column, qualified: Column, kind: Column) -> Column:
    return F.concat(path, F.lit("::"), qualified, F.lit("#"), F.lower(kind))


def parse_symbol_id(id: Column) -> Column:
    """(file_path, qualified_name, kind) of an identifier, cut at the first :: and the last #; nulls if it has none."""
    part = lambda n: F.nullif(F.regexp_extract(id, r"(?s)^(.*?)::(.*)#([^#]*)$", n), F.lit(""))
    return F.struct(part(1).alias("file_path"), part(2).alias("qualified_name"), part(3).alias("kind"))


def signature(text: Column) -> Column:
    """First line, trimmed; beyond 200 characters cut, with dots."""
    line = F.trim(F.regexp_replace(F.split(text, "\n", 2)[0], r"^\s+|\s+$", ""))
    return F.when(F.char_length(line) > 200, F.concat(F.left(line, F.lit(200)), F.lit("..."))).otherwise(line)


def summary(given: Column, signature: Column, kind: Column, qualified: Column, docstring: Column | None = None) -> Column:
    """The first that isn't blank: given, docstring, signature, kind and name."""
    real = lambda c: F.when(F.trim(c) != "", c)
    tried = [given] + ([docstring] if docstring is not None else []) + [signature]
    return F.coalesce(*[real(c) for c in tried], F.concat_ws(" ", kind, qualified))


def docstring(source: Column, language: Column) -> Column:
    """First line of comment or documentation in a source, without its marks; null for languages that have no rule, and where there is none."""
    lines = F.transform(F.split(source, "\n"), lambda x: F.trim(x))
    python = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.startswith('"""') | x.startswith("'''"))
    slashes = F.filter(lines, lambda x: x.startswith("//"))
    stars = F.filter(lines, lambda x: x.startswith("//") | x.startswith("/*"))
    pick = lambda found, marks: F.btrim(F.try_element_at(found, F.lit(1)), F.lit(marks))
    return F.when(language == "python", pick(python, "\"' ")).when(language.isin("csharp", "java", "javascript", "typescript"), pick(stars, "/* ")).when(language.isin("go", "rust"), pick(slashes, "/ "))


def occurrences(text: Column, needle: str) -> Column:
    """How often needle is in text, case aside, without overlaps. An empty needle raises."""
    if not needle:
        raise ValueError("an empty query is in every text without end")
    low = F.lower(text)
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / F.lit(len(needle))).cast("int")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes start to end of the text's UTF-8, ends clamped; bytes of a broken character are replaced."""
    raw = F.encode(text, "UTF-8")
    a = F.greatest(F.lit(0), F.least(start, F.octet_length(text)))
    b = F.greatest(a, F.least(end, F.octet_length(text)))
    return F.make_valid_utf8(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
