import zlib

from tandem.llm.sharding import shards


def test_contiguous_and_balanced(docs, rows):
    n = 7
    got = sorted(shards(docs, n).collect(), key=lambda r: r.doc_id)
    size = {i: len((t or "").encode()) + 16 for i, t, *_ in rows}
    total, largest = sum(size.values()), max(size.values())
    assert {r.doc_id: r["size"] for r in got} == size
    assert {r.doc_id: r.text_crc32 for r in got} == {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    for s in range(n):
        own = [r for r in got if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest


def test_odd_rows(odd, none):
    got = shards(odd, 3).collect()
    assert len(got) == 6 and got
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})
    assert shards(none, 3).count() == 0
