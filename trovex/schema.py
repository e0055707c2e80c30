"""Schemas of the index tables and the engine's options."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import timedelta


KINDS = ("Function", "Class", "Method", "Constant", "Type", "Interface", "Enum", "Property", "Field", "Module", "Unknown")
MATCH_TYPES = ("Exact", "Fuzzy", "BM25")



_SYMBOL = (
    "repo_key string, id string, file_path string, qualified_name string, kind string, name string, language string, signature string, "
    "summary string, byte_start bigint, byte_end bigint, start_line int, end_line int, content_hash string, parent_id string, "
    "references array<string>, centrality_score double, keywords array<string>"
)
DDL = {
    "symbols": _SYMBOL,
    "files": "repo_key string, path string, language string, size_bytes bigint, sha string, file_hash string",
    "raw_source": "repo_key string, file_path string, content string",
    "index_meta": "repo_key string, repo_url string, is_local boolean, indexed_at timestamp, index_seconds double, symbol_count bigint, file_count bigint, total_bytes bigint",
    "edges": "src_id string, dst_id string",
    "changes": "path string, status string",
}


def ddl(table: str) -> str:
    """The table's schema as DDL."""
    return DDL[table]


@dataclass(frozen=True)
class Options:
    """index_path: where the index tables are. max_file_bytes: larger files are left out. max_files: of one repository, in the order of paths. fuzzy_threshold: least similarity of a fuzzy match, of 100."""

    index_path: str = field(default_factory=lambda: os.path.expandvars(os.environ.get("TROVEX_INDEX", "")) or os.path.join(os.path.expanduser("~"), ".trovex"))
    max_file_bytes: int = 1_000_000
    max_files: int = 10_000
    fuzzy_threshold: int = 70
    staleness: timedelta = timedelta(days=7)
