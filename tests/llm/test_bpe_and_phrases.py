import sys
import tracemalloc

import numpy as np
import pytest
import tiktoken

from tests.llm import brute
from tests.llm.conftest import LONG, ROWS
from trovex.llm import bpe, phrases, queries


@pytest.fixture(scope="module")
def other():
    b = bpe.vocabulary()
    return tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_query_against_another_encoder(spark, sf, docs, other):
    want = {r.doc_id: other.encode_ordinary(r.text) for r in docs.select("doc_id", "text").collect()}
    rows = queries.op3_bpe(spark, sf).collect()
    assert {r.doc_id: r.tokens for r in rows} == want
    assert all(r.exact and r.n_tokens == len(r.tokens) for r in rows)


@pytest.mark.parametrize("word", ["a" * 199, "a" * 201, "ab" * 3000, "é漢字🙂" * 400, "x" * 20_000, "unbelievably", "\0\x01", "qzxj" * 51])
def test_short_and_long_pieces(other, word):
    b = bpe.Bpe()
    assert b.piece(word.encode()) == other.encode_ordinary(word) == (b.long_piece(word.encode()) if word.encode() not in b.ranks else b.piece(word.encode()))
    assert b.decode(np.array(b.piece(word.encode()))) == word.encode()


def test_a_long_text_of_many_pieces_takes_little_memory(other):
    text = " ".join(map(str, range(10_000_000, 10_250_000)))
    b = bpe.Bpe()
    ids = np.frombuffer(b.encode(text), "<i4")
    assert ids.tolist() == other.encode_ordinary(text)
    assert sum(sys.getsizeof(x) for c in (b.cache, b.older) for pair in c.items() for x in pair) <= 16 << 20
    tracemalloc.start()
    back = b.decode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == text.encode() and peak < 6 * len(text)
    assert b.decode(ids[:0]) == b""


def test_bpe_on_messy_rows(messy, none, other):
    rows = bpe.encode_documents(messy).collect()
    key = lambda x: (str(x[0]), str(x[1])[:100])
    want = [(i, None if t is None else other.encode_ordinary(t)) for i, t, *_ in ROWS]
    assert sorted(((r.doc_id, r.tokens) for r in rows), key=key) == sorted(want, key=key)
    assert all((r.n_tokens, r.exact) == ((None, None) if r.tokens is None else (len(r.tokens), True)) for r in rows)
    back = bpe.decode_documents(bpe.encode_documents(messy)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t) for i, t, *_ in ROWS), key=key)
    assert bpe.encode_documents(none).count() == 0


def test_phrases_query_against_plain_python(spark, sf, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in queries.op5_phrases(spark, sf).collect():
        assert list(zip(r.phrases, r.starts)) == brute.phrases(texts[r.doc_id]) and r.n_phrases == len(r.phrases)


def test_phrases_on_messy_rows(messy, none):
    got = [(r.doc_id, None if r.phrases is None else list(zip(r.phrases, r.starts))) for r in phrases.fingerprints(messy).collect()]
    want = [(i, None if t is None else brute.phrases(t)) for i, t, *_ in ROWS]
    key = lambda x: (str(x[0]), str(x[1])[:60])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert phrases.fingerprints(none).count() == 0


def test_equal_passages_share_interior_phrases_at_any_offset():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij klmnop"))
    passage = "".join(letters[rng.integers(0, len(letters), 3000)])
    interior = None
    for before in (0, 1, 2, 3, 7, 100, 501):
        head = "".join(letters[rng.integers(0, len(letters), before)])
        at = {s - before: x for x, s in brute.phrases(head + passage + head[::-1])}
        inner = {s: x for s, x in at.items() if 700 <= s < 2300}
        assert len(inner) > 5
        interior = interior or inner
        assert inner == interior
    assert len(brute.phrases(LONG[:20_000])) < 2000
