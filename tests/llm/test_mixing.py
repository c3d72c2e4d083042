import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing

from .helpers import SCHEMA, awkward, empty, frame


def totals(rows):
    t = Counter()
    for _, text, _, source, *_ in rows:
        t[source or ""] += len((text or "").split())
    return t


def test_schedule(spark):
    rows = awkward()
    got = mixing.mixture(frame(spark), block_tokens=500).collect()
    t = totals(rows)
    most = max(t.values())
    least = min(v for v in t.values() if v)
    alpha = max(0.0, 1 - math.log(2.0) / math.log(most / least))
    used = defaultdict(int)
    for r in got:
        used[r.source] += r.tokens
    for s, n in t.items():
        budget = n * (most / n) ** (1 - alpha)
        assert budget - 1 <= used[s] <= budget + max(len((x[1] or "").split()) for x in rows) * 2
    ids = {(r[0], r[3] or "") for r in rows}
    assert {(r.doc_id, r.source) for r in got} == ids
    assert len({(r.block, r.slot) for r in got}) == len(got)
    for block, n in Counter(r.block for r in got).items():
        assert sorted(r.slot for r in got if r.block == block) == list(range(n))
    assert all(r.epoch <= 2 for r in got)
    # the blocks have the sources in their weights
    for r in got:
        assert 0 <= r.block < math.ceil(sum(used.values()) / 500) + 1


def test_entropy_target(spark):
    df = spark.createDataFrame([(i, "w " * n, "en", s, 0, "k", 0) for i, (n, s) in enumerate([(400, "a"), (50, "b"), (10, "c")] * 3)], SCHEMA)
    t = df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("tokens"))
    alpha = mixing.bisect_exponent(t, None, 0.9)
    p = [n**alpha for n in (1200, 150, 30)]
    p = [x / sum(p) for x in p]
    assert -sum(x * math.log(x) for x in p) == pytest.approx(0.9, abs=1e-6)


def test_mixed_documents(spark):
    df = frame(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = {tuple(r) for r in df.collect()}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) > len(want)
    assert mixing.mixed_documents(empty(spark)).collect() == [] and mixing.mixture(empty(spark)).collect() == []


def test_no_tokens(spark):
    df = spark.createDataFrame([(1, None, None, None, None, "k", 0), (2, "", "en", "a", 0, "k", 0)], SCHEMA)
    assert Counter((r.doc_id, r.epoch, r.tokens) for r in mixing.mixture(df).collect()) == {(1, 1, 0): 1, (2, 1, 0): 1}
