import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES, ROWS
from tests.oracle import connect, same
from trovex.llm import queries, sstable, warc


def shards_of(rows):
    found = rows.collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.shard, r.offset)):
        assert r.offset == len(out.get(r.shard, b""))
        out[r.shard] = out.get(r.shard, b"") + bytes(r.payload)
    return {k: sstable.Shard(v) for k, v in out.items()}, found


def test_sstable_query_gives_every_document_back(spark, sf, docs):
    shards, rows = shards_of(queries.op1_sstable(spark, sf))
    want = {r.doc_id: r.asDict() for r in docs.collect()}
    for i, row in want.items():
        values = [json.loads(v) for s in shards.values() for v in s.get(i)]
        assert values == [{k: v for k, v in row.items() if k != "doc_id"}]
    assert not any(s.get(i) for s in shards.values() for i in (-1, 10**9, None))
    data = sorted((r.shard, r.offset, bytes(r.first_key), bytes(r.last_key)) for r in rows if r.kind == "data")
    assert all(x[3] <= y[2] for x, y in zip(data, data[1:]))
    assert sum(s.entries for s in shards.values()) == len(want)


@pytest.mark.parametrize("layout", [sstable.Layout(block_bytes=1, restart=1), sstable.Layout(block_bytes=300, shard_bytes=1500, restart=3), sstable.Layout()])
def test_sstable_on_messy_rows(messy, none, layout):
    rows = sstable.sorted_shards(messy, cfg=layout)
    shards, _ = shards_of(rows)
    for i in {r[0] for r in ROWS}:
        got = Counter(json.loads(v)["text"] for s in shards.values() for v in s.get(i))
        assert got == Counter(t for j, t, *_ in ROWS if j == i)
    one = json.loads(next(v for s in shards.values() for v in s.get(9)))
    assert set(one) == {"text", "lang", "source", "n_chars", *CLASHES}
    assert sstable.sorted_shards(none, cfg=layout).count() == 0


def test_sstable_of_strings_with_common_prefixes(spark):
    names = [f"https://example.org/a/long/path/{i % 97:03d}/{i}" for i in range(2000)]
    docs = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, text bigint")
    small = sstable.sorted_shards(docs, "url", sstable.Layout(block_bytes=2000, shard_bytes=20_000))
    whole = sstable.sorted_shards(docs, "url", sstable.Layout(block_bytes=2000, shard_bytes=20_000, restart=1))
    shards, rows = shards_of(small)
    assert len(shards) > 1
    for i in (0, 7, 999, 1999):
        assert [json.loads(v) for s in shards.values() for v in s.get(names[i])] == [{"text": i}]
    assert sum(len(r.payload) for r in rows) < 0.7 * sum(len(r.payload) for r in whole.collect())
    k = sorted(s.index[0][0] for s in shards.values())[0]
    assert str(sstable.id_of(k)).startswith("https://") and sstable.id_of(sstable.key_of(-5)) == -5 and sstable.id_of(sstable.key_of(None)) is None


def test_bloom_filter_lets_few_others_through():
    bloom = sstable.Bloom([sstable.Bloom.hash(sstable.key_of(i)) for i in range(5000)], 10).bytes()
    assert all(sstable.Bloom.may_have(bloom, sstable.key_of(i)) for i in range(5000))
    assert sum(sstable.Bloom.may_have(bloom, sstable.key_of(i)) for i in range(10**6, 10**6 + 5000)) < 150


def test_damaged_block_raises():
    b = sstable.Block(2)
    for i in range(10):
        b.add(sstable.key_of(i), b"v%d" % i)
    data = bytearray(b.bytes())
    assert sstable.find(bytes(data), sstable.key_of(4)) == [b"v4"] and sstable.find(bytes(data), sstable.key_of(44)) == []
    data[9] ^= 1
    with pytest.raises(ValueError):
        sstable.find(bytes(data), sstable.key_of(4))


def test_lookup_of_few_and_of_many(spark, docs, monkeypatch):
    rows = sstable.sorted_shards(docs, cfg=sstable.Layout(block_bytes=5000)).cache()
    keys = spark.createDataFrame([(3,), (3,), (150,), (10**7,)], "doc_id bigint")
    for most in (sstable.FEW_KEYS, 0):
        monkeypatch.setattr(sstable, "FEW_KEYS", most)
        assert sorted(sstable.id_of(bytes(r.key)) for r in sstable.lookup(rows, keys).collect()) == [3, 150]
    wanted = sstable._as_keys(keys, "doc_id")
    opened = sstable.located(rows, wanted).count()
    assert opened <= 2 < 20 < rows.where("kind = 'data'").count()  # one block for each key that is there, none for the others
    assert sstable.lookup(rows, keys.where("false")).count() == 0


def test_warc_as_duckdb(spark, sf):
    assert same(spark, connect(sf), queries.QUERIES["op10_warc"], queries.SQL["op10_warc"], sf) > 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "<p>x</p>", "c"), (2, "http://b", "<p>x</p>", "c"), (2, "http://b", "<p>x</p>", None), (3, None, "", "c"), (4, "http://c", None, "c"), (None, None, None, None), (5, "http://d", "ü" * 400_000, "c")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").withColumn("payload", F.lit("clash")).withColumn("id", F.lit(0))


def test_warc_on_messy_rows(spark, pages, tmp_path):
    warc.write_archive(pages, str(tmp_path))
    bodies = spark.read.parquet(f"{tmp_path}/payloads").collect()
    assert Counter(r.uses for r in bodies) == Counter([3, 1, 1]) and all(r.size == len(r.payload) for r in bodies)
    got = Counter((r.id, r.record.decode()) for r in warc.read_archive(spark, str(tmp_path)).collect())
    assert sum(got.values()) == 7 and len(got) == 6
    heads = {i: x.split("\r\n\r\n", 1) for i, x in got}
    for i, url, html, *_ in pages.collect():
        head, body = heads[i]
        assert body == (html or "") and f"Content-Length: {len(body.encode())}" in head
        assert (f"WARC-Target-URI: {url}" in head) == (url is not None) and ("Payload-Digest" in head) == (html is not None)
    none = warc.archive(pages.where("false"))
    assert none[0].count() == none[1].count() == warc.records(*none).count() == 0


def test_changed_or_missing_payload_stops_the_job(pages):
    headers, bodies = warc.archive(pages)
    with pytest.raises(Exception, match="payload missing or changed"):
        warc.records(headers, bodies.withColumn("payload", F.encode(F.lit("other"), "UTF-8"))).collect()
    with pytest.raises(Exception, match="payload missing or changed"):
        warc.records(headers, bodies.where("size > 100")).collect()


def test_bytes_and_headers_come_back_as_they_were(spark):
    rows = [(1, bytearray(b"\xff\xd8\x00"), bytearray(b"WARC/1.1\r\nX: \xe9\r\n\r\n")), (2, bytearray(b"\xff\xd8\x00"), bytearray(b"WARC/1.0\r\n\r\n")), (3, bytearray(bytes(range(256)) * 5000), None), (4, None, bytearray(b"h"))]
    pages = spark.createDataFrame(rows, "page_id int, html binary, head binary")
    headers, bodies = warc.archive(pages, header="head")
    assert bodies.count() == 2
    assert {r.id: bytes(r.record) for r in warc.records(headers, bodies).collect()} == {i: bytes(h or b"") + bytes(b or b"") for i, b, h in rows}
    made = warc.archive(pages.withColumn("url", F.lit("u")))
    assert all(bytes(r.record).endswith(bytes(rows[r.id - 1][1] or b"")) for r in warc.records(*made).collect())
