import zlib
from collections import Counter, defaultdict

from heliograph.llm.sharding import shard_digest, shuffled_shards


def test_awkward_rows(docs, awkward):
    rows = shard_digest(docs, 7).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in awkward)
    assert Counter(tuple(r)[:3] for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_rows_come_whole_and_shuffled(docs, awkward):
    rows = shuffled_shards(docs, 3).select("row.*")
    assert rows.columns == docs.columns
    assert Counter(map(repr, rows.collect())) == Counter(map(repr, docs.collect()))


def test_more_shards_than_rows_and_empty_table(docs, no_docs):
    rows = shard_digest(docs.limit(3), 40).collect()
    assert Counter(r.shard for r in rows) == Counter({0: 1, 1: 1, 2: 1})
    assert shard_digest(no_docs).collect() == []
