import random
from collections import Counter

import pytest

from tests.llm.conftest import ROWS
from tests.oracle import connect, same
from trovex.llm import licenses, queries


def test_as_duckdb(spark, sf):
    assert same(spark, connect(sf), queries.QUERIES["op2_licenses"], queries.SQL["op2_licenses"], sf) > 0


T = 'Permission is granted to <<var;name="who";original="any person";match="\\w+{1,3}">> to use<<beginOptional>>, copy<<beginOptional>> and sell<<endOptional>><<endOptional>> this work. <<var;name="y";original="2000";match="[0-9]+">>'


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("Permission is granted to any person to use this work. 1999", 11), ("PERMISSION is granted, to one to use, copy this WORK 7!", 11), ("x permission is granted to a b c to use copy and sell this work 3 x", 15),
        ("Permission is granted to a b c d to use this work. 1999", 0), ("Permission is granted to to use this work 1999", 0), ("Permission is granted to all to use and sell this work 1999", 0), ("Permission is granted to all to use this work year", 0),
        ("Permission is granted to all to use this", 0), ("", 0),
    ],
)
def test_mandatory_wording_is_exact(text, words):
    found = licenses.matches(licenses.tokens(text), {"T": licenses.compiled(T)})
    assert [b - a for _, a, b in found] == ([words] if words else [])


def accepts(nodes, words, at=0):
    """All ends of what the nodes accept from at on, by trying everything."""
    if not nodes:
        return {at}
    head, rest, ends = nodes[0], nodes[1:], set()
    if isinstance(head, list):
        mid = accepts(head, words, at) | {at}
    elif isinstance(head, licenses.Var):
        import re

        mid = {at + k for k in range(head.least, head.most + 1) if at + k <= len(words) and all(re.fullmatch(head.pattern, w) for w in words[at : at + k])}
    else:
        mid = {at + 1} if words[at : at + 1] == [head] else set()
    for m in mid:
        ends |= accepts(rest, words, m)
    return ends


def test_automata_against_trying_everything():
    rng = random.Random(5)

    def made(depth=0):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            out.append(made(depth + 1) if kind < 0.2 and depth < 2 else licenses.Var(rng.randint(0, 1), rng.randint(1, 3), rng.choice([r"\w+", "a|b"])) if kind < 0.4 else rng.choice("abc"))
        return out

    for _ in range(300):
        nodes = ["c", *made()]
        a = licenses.Automaton()
        a.accept = a.build(0, nodes)
        words = [rng.choice("abc") for _ in range(8)]
        for start in range(len(words)):
            assert a.longest(words, start) == max(accepts(nodes, words, start) | {start})


@pytest.mark.parametrize("bad", ["a <<endOptional>>", "<<beginOptional>> a", "<<what>> a", "<<beginOptional>>a<<endOptional>>"])
def test_bad_templates_raise(bad):
    with pytest.raises(ValueError):
        licenses.compiled(bad)


def test_messy_rows(messy, none, spark):
    assert [(r.doc_id, r.license, r.matches) for r in licenses.scan(messy).collect()] == [(7, "MIT", 1)]
    found = licenses.scan(messy, {"A": "alpha beta", "F": "fox jumps <<beginOptional>>over <<endOptional>>lazy"}).collect()
    assert Counter((r.doc_id, r.license) for r in found) == Counter([(1, "A"), (1, "A"), (2, "A"), (None, "A"), (6, "F")])
    assert next(r.matches for r in found if r.doc_id == 6) == 4000 and len(ROWS) == messy.count()
    assert licenses.scan(none).count() == 0 and licenses.scan(messy, {}).count() == 0


def test_british_spelling_passes_the_first_filter(spark):
    docs = spark.createDataFrame([(1, "Licenced under the MIT Licence"), (2, "Licensed by MIT")], "doc_id bigint, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(1, "MIT")]
