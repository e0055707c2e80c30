"""Operator 2: license scans by template-markup matching.

A template is wording with regions in markup: <<beginOptional>> ... <<endOptional>> may be left out, and
<<var;name="...";original="...";match="...">> may be replaced by tokens that match. Templates are compiled to token automata.
A passage of a text is a license if an automaton accepts exactly its tokens: all mandatory wording is there, in order
and unchanged, and nothing else but what the regions allow. Case, punctuation, white space and a few spellings don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovex.llm import kernel as K
from trovex.llm.shared import col

TOKEN = re.compile(r"[^\W_]+")
#: Spellings that are taken as one.
SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "favour": "favor", "organisation": "organization"}
_MARK = re.compile(r"<<(.*?)>>", re.S)


@dataclass(frozen=True)
class Var:
    """A replaceable region: least to most tokens, each of which matches the pattern in full."""

    least: int
    most: int
    pattern: str


def tokens(text: str) -> list[str]:
    return [SAME.get(t, t) for t in TOKEN.findall(text.lower())]


def parse(template: str) -> list:
    """The template as a nested list of tokens, Vars, and lists for optional regions.

    A var's match is a pattern for one token, or a pattern and the least and most tokens as in \\w+{1,6}; without match, 1 to 10 tokens.
    """
    stack: list[list] = [[]]
    for k, part in enumerate(_MARK.split(template)):
        if k % 2 == 0:
            stack[-1] += tokens(part)
        elif part.startswith("beginOptional"):
            stack.append([])
        elif part.startswith("endOptional"):
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            region = stack.pop()
            stack[-1].append(region)
        elif part.startswith("var"):
            match = dict(re.findall(r'(\w+)="(.*?)"', part)).get("match", r"\w+{1,10}")
            count = re.search(r"\{(\d+),(\d+)\}$", match)
            stack[-1].append(Var(int(count[1]), int(count[2]), match[: count.start()]) if count else Var(1, 1, match))
        else:
            raise ValueError(f"unknown markup: {part[:40]}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


@dataclass
class Automaton:
    """States 0 to accept; moves by token, moves by pattern, and free moves, by state."""

    exact: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    loose: list[list[tuple[re.Pattern, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    accept: int = 0

    def _state(self) -> int:
        self.exact.append({})
        self.loose.append([])
        self.free.append([])
        return len(self.free) - 1

    def build(self, at: int, nodes: list) -> int:
        for node in nodes:
            if isinstance(node, list):
                end = self.build(at, node)
                self.free[at].append(end)
                at = end
            elif isinstance(node, Var):
                pattern = re.compile(node.pattern)
                skips = []
                for k in range(node.most):
                    if k >= node.least:
                        skips.append(at)
                    nxt = self._state()
                    self.loose[at].append((pattern, nxt))
                    at = nxt
                for s in skips:
                    self.free[s].append(at)
            else:
                nxt = self._state()
                self.exact[at].setdefault(node, []).append(nxt)
                at = nxt
        return at

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[str], start: int) -> int:
        """End of the longest accepted run of words from start on; start if there is none."""
        states, end, i = self.close({0}), start, start
        while states:
            if self.accept in states:
                end = i
            if i == len(words):
                break
            w, nxt = words[i], set()
            for s in states:
                nxt.update(self.exact[s].get(w, ()))
                nxt.update(t for p, t in self.loose[s] if p.fullmatch(w))
            states, i = self.close(nxt), i + 1
        return end


def compiled(template: str) -> Automaton:
    nodes = parse(template)
    if all(not isinstance(n, str) for n in nodes):
        raise ValueError("a template needs mandatory wording")
    a = Automaton()
    a.accept = a.build(0, nodes)
    return a


def anchor(template: str) -> str:
    """Lower-case characters that every text with this license has: of the longest mandatory token, what its spellings share."""
    spellings = {}
    for k, v in SAME.items():
        spellings.setdefault(v, []).append(k)

    def shared(t: str) -> str:
        for other in spellings.get(t, []):
            t = t[: next((i for i, (x, y) in enumerate(zip(t, other)) if x != y), min(len(t), len(other)))]
        return t

    return max((shared(n) for n in parse(template) if isinstance(n, str)), key=len)


def matches(words: list[str], automata: Mapping[str, Automaton]) -> list[tuple[str, int, int]]:
    """(license, first token, end) of every license's passages: leftmost, longest, not overlapping others of that license."""
    out = []
    for name, a in automata.items():
        first = a.close({0})
        begins = {w for s in first for w in a.exact[s]}
        any_begin = any(a.loose[s] for s in first)
        i = 0
        while i < len(words):
            if any_begin or words[i] in begins:
                end = a.longest(words, i)
                if end > i:
                    out.append((name, i, end))
                    i = end
                    continue
            i += 1
    return out


_ANY = r'<<var;name="work";original="work";match="\w+{1,6}">>'
_AS_IS_END = """IN NO EVENT SHALL <<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match="\\w+{1,12}">> BE LIABLE FOR ANY"""
#: Templates by identifier. Wording is that of the public license texts and of the notices they recommend.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0<<beginOptional>> (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match="\\w+{1,12}">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>>""",
    "MIT": """<<var;name="verb";original="Released";match="released|licensed|distributed|available">> under the <<beginOptional>>terms of the <<endOptional>>MIT License""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="work";original="this software and associated documentation files";match="\\w+{1,8}">>
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. """
    + _AS_IS_END
    + """ CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>>3. Neither the name of <<var;name="organization";original="the copyright holder";match="\\w+{1,10}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.<<endOptional>>""",
    "ISC": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": """<<beginOptional>>This """
    + _ANY
    + """ is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either <<endOptional>>version 3<<beginOptional>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, <<beginOptional>>either <<endOptional>>version 3 of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.""",
    "CC-BY-4.0": """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY 4.0<<beginOptional>> License<<endOptional>>""",
    "CC-BY-SA-4.0": """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-SA 4.0<<beginOptional>> License<<endOptional>>""",
    "CC-BY-NC-4.0": """Licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-NC 4.0<<beginOptional>> License<<endOptional>>""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name="url";original="http://mozilla.org/MPL/2.0/";match="\\w+{1,8}">>""",
}


@lru_cache(8)
def _bank(templates: tuple[tuple[str, str], ...]) -> dict[str, Automaton]:
    return {k: compiled(v) for k, v in templates}


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, license, matches, first_token, words) for every row and license with a passage: how many, where the first begins, and the tokens of the longest.

    Null and empty texts have none. Identifiers may be null or repeat: each row is scanned by itself. Other columns are
    dropped. No templates or an empty table give no rows. A template without mandatory wording raises.
    """
    given = tuple((TEMPLATES if templates is None else templates).items())
    _bank(given)
    anchors = sorted({anchor(t) for _, t in given})
    lowered = F.lower(col(docs, text).cast("string"))
    has = F.lit(False)
    for a in anchors:  # what every match must have; rows without are not sent to Python
        has = has | lowered.contains(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, kept = _bank(given), [(anchor(t), k) for k, t in given]
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py().lower()
                near = {k: bank[k] for a, k in kept if a in t}
                if not near:
                    continue
                words = [SAME.get(w, w) for w in TOKEN.findall(t)]
                found: dict[str, list[int]] = {}
                for name, a, b in matches(words, near):
                    f = found.setdefault(name, [0, a, 0])
                    f[0], f[2] = f[0] + 1, max(f[2], b - a)
                rows += [(i, k, *v) for k, v in found.items()]
            at, names, n, first, size = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), *(pa.array(x, pa.int32()) for x in (n, first, size))], names=["id", "license", "matches", "first_token", "words"])

    slim = docs.where(has).select(col(docs, id).alias("id"), col(docs, text).cast("string").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, license string, matches int, first_token int, words int").withColumnRenamed("id", id)


def _regex(nodes: list) -> str:
    out = ""
    for n in nodes:
        if isinstance(n, list):
            out += f"(?:{_regex(n)})?"
        elif isinstance(n, Var):
            word = {r"\w+": r"[\p{L}\p{N}]+"}.get(n.pattern, n.pattern)
            out += f"(?: (?:{word}) ){{{n.least},{n.most}}}"
        else:
            out += f" {n} "
    return out


def sql(templates: Mapping[str, str] | None = None) -> str:
    """DuckDB's way to the rows of scan: each token between blanks, templates as regular expressions over them."""
    given = TEMPLATES if templates is None else templates
    same = "t"
    for a, b in SAME.items():
        same = f"CASE WHEN t = '{a}' THEN '{b}' ELSE {same} END"
    one = "\n".join(
        f"{'UNION ALL' if n else ''} SELECT doc_id, '{k}' AS license, norm, regexp_extract_all(norm, '{_regex(parse(v))}') AS found, regexp_extract(norm, '^(.*?){_regex(parse(v))}', 1) AS ahead FROM docs"
        for n, (k, v) in enumerate(given.items())
    )
    return rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: ' ' || ({same}) || ' '), '') AS norm FROM documents WHERE text <> ''),
found AS ({one})
SELECT doc_id, license, len(found)::INT AS matches, len(regexp_extract_all(ahead, '[^ ]+'))::INT AS first_token,
  list_max(list_transform(found, lambda m: len(regexp_extract_all(m, '[^ ]+'))))::INT AS words
FROM found WHERE len(found) > 0
"""
