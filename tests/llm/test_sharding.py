import zlib
from collections import Counter, defaultdict

import pytest

from rasterloom.llm import sharding

from .helpers import awkward, empty, frame


@pytest.mark.parametrize("shards", [24, 5])
def test_shards(spark, shards):
    rows = awkward(n=300)
    got = sharding.shard_by_bytes(frame(spark, rows), shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s, part in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / shards) <= largest + 2 * sharding.TOLERANCE * total / shards + 1
    assert sharding.shard_by_bytes(empty(spark)).collect() == []


def test_a_hot_text_is_divided(spark):
    rows = [(i, "same text " * 50, "en", "s", 0, "k", 0) for i in range(400)] + awkward(n=40)
    got = sharding.shard_by_bytes(frame(spark, rows), shards=8).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    largest = max(r.size for r in got)
    assert all(abs(v - mean) <= largest + 1 for v in size.values())
