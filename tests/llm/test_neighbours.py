import numpy as np
import pytest

from rasterloom.llm import neighbours


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float(neighbours.cosine(v[None], w[None])[0]), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("blocks", [(4096, 8192), (3, 16)])
def test_nearest(spark, monkeypatch, blocks):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "ROW_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(130 + i, rows[10][1]) for i in range(20)]  # ties
    rows += [(200, None), (210, [0.0] * 8), (220, [float("nan")] * 8), (230, [float("inf")] + [1.0] * 7), (240, [1.0, None] + [0.0] * 6), (250, []), (None, rows[0][1]), (260, [1.0, 2.0]), (261, [2.0, 1.0]), (270, (np.array(rows[10][1]) * 3).tolist())]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    got = {}
    for r in neighbours.nearest(df, k=5, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(rows, 5, 10)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(70, 64))
    qc, qs, qn, qe = neighbours.quantised(a)
    rc, rs, rn, re = neighbours.quantised(b)
    near = (qc @ rc.T) * qs[:, None] * rs[None]
    slack = qn[:, None] * re[None] + qe[:, None] * rn[None] + qe[:, None] * re[None]
    exact = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
    assert (np.abs(exact - near) <= slack + 1e-6).all()


def test_repeated_query_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(0, rng.normal(size=8).tolist()), (0, rng.normal(size=8).tolist())] + [(i, rng.normal(size=8).tolist()) for i in (1, 2, 3)]
    rows += [rows[0]] * 2
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), k=2, every=10).collect()
    want = []
    for i, v in rows:
        if i == 0:
            best = sorted((-float(neighbours.cosine(np.array([v]), np.array([w]))[0]), j) for j, w in rows if j)
            want += [(0, r + 1, j, -s) for r, (s, j) in enumerate(best[:2])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
