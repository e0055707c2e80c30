"""Similarity of a query with the best part of a name, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: bits of a row at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, times 100."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


@lru_cache(100_000)
def partial_ratio(a: str, b: str) -> int:
    """Best ratio, 0 to 100, of the shorter string with the parts of the longer one that begin where the two have a block in common. An empty string is like nothing but another one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100 if not long else 0
    best = 0.0
    for i, j, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        start = max(0, j - i)
        best = max(best, ratio(short, long[start : start + len(short)]))
        if best > 99.5:
            return 100
    return round(best)


def similarity(query: str) -> Callable[[Column], Column]:
    """A column function: partial_ratio of the query with lower-cased names. Distinct names of a batch are compared once."""
    low = query.lower()

    @F.pandas_udf("int")
    def run(names: pd.Series) -> pd.Series:
        found = {n: partial_ratio(low, n.lower()) for n in names.dropna().unique()}
        return names.map(found).astype("Int32")

    return run


def letters_allow(query: str, name: Column, threshold: int) -> Column:
    """Whether name can reach the threshold at all, judged on the JVM side by the letters it shares: no match is lost.

    A window of m <= n characters has at most as many letters in common with the query as the query has letters that occur in the name.
    """
    low = query.lower()
    if not low:
        return F.lit(True)
    has = [F.lower(name).contains(c).cast("int") * low.count(c) for c in sorted(set(low))]
    total = has[0]
    for h in has[1:]:
        total = total + h
    short = F.least(F.char_length(name), F.lit(len(low)))
    most = F.least(total, short)
    # A window may be shorter than the query at the name's end, so no more than 2 * most / (short + most); rounding gives half a point.
    return (F.lit(200.0) * most / F.greatest(short + most, F.lit(1)) + 0.5 >= threshold) | (F.char_length(name) < len(low))
