"""Two-stage suffix arrays and repeated strings, against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from rasterloom.llm import suffixes


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + 1 + seed % 3, 300).astype(np.uint8)
    data[200:] = data[:100]
    got = suffixes.two_stage_suffix_array(data, 400)
    raw = data.tobytes()
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    for depth in (9, 16, 21):
        common = suffixes.common_prefixes(data, got, depth)
        assert common.tolist() == [0] + [min(depth, len(os.path.commonprefix([raw[a:], raw[b:]]))) for a, b in zip(got[1:], got[:-1])]
    assert suffixes.two_stage_suffix_array(np.zeros(0, np.uint8), 4).tolist() == []
    zeros = np.frombuffer(b"ab\0\0ab\0ab", np.uint8)
    assert suffixes.two_stage_suffix_array(zeros, 40).tolist() == sorted(range(9), key=lambda i: zeros.tobytes()[i:])


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_strings(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (12, 20, 40)]
    texts = [" ".join(rng.choice([word(), word(), word(), rng.choice(passages)]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    texts += [None, "", "a" * 300, "ab" * 90, texts[3], texts[3], passages[2], "x" + passages[2], "short"]
    rows = [(i if i % 17 else None, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, core string").repartition(5)
    got = suffixes.repeated_strings(df, length=40, block_bytes=3000, hot_contexts=hot).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute(texts, 40)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffixes.repeated_strings(df).collect() == []
