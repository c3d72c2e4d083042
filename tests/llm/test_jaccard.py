import random

import pytest

from rasterloom.llm import jaccard

from .helpers import SCHEMA, awkward, empty, frame, prose


def brute(rows, k=5, least=0.8):
    def grams(t):
        w = (t or "").split()
        n = min(k, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    texts = sorted({r[1] or "" for r in rows})
    sets = {t: grams(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= least * len(sets[t] | sets[u])] for t in texts}
    label = {}
    for t in texts:
        if t not in label:
            todo = [t]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = t
                    todo += links[x]
    ids = {}
    for r in rows:
        if r[0] is not None:
            at = label[r[1] or ""]
            ids[at] = min(r[0], ids.get(at, r[0]))
    return [(r[0], ids.get(label[r[1] or ""]), len(links[r[1] or ""])) for r in rows]


def near_rows(seed, groups=12, size=6):
    rng, rows = random.Random(seed), awkward(seed)
    for _ in range(groups):
        base = prose(rng, 120).split()
        for j in range(size):
            words = base[:]
            for _ in range(j % 4):
                words[rng.randrange(len(words))] = f"w{rng.random()}"
            rows.append((1000 + len(rows), " ".join(words), "en", "s", 0, "k", 0))
    return rows


@pytest.mark.parametrize("small", [32, 4])
def test_against_brute_force(spark, small):
    rows = near_rows(5)
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, rows), small=small).collect()]
    want = brute(rows)
    assert sorted((x[:2] for x in got), key=str) == sorted((x[:2] for x in want), key=str)
    if small == 32:
        assert sorted(got, key=str) == sorted(want, key=str)


def test_large_group_is_one_class(spark):
    rng = random.Random(1)
    base = prose(rng, 200).split()
    rows = []
    for i in range(300):
        words = base[:]
        words[rng.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(words), "en", "s", 0, "k", 0))
    got = jaccard.near_duplicates(frame(spark, rows), small=8).collect()
    assert {r.class_id for r in got} == {0} and all(r.n_links for r in got)


def template_rows(size, own=3):
    """Copies of a template with a few words of their own; x is one of them, y is near x only."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(size):
        words = base[:]
        for j in range(own):
            words[rng.randrange(400)] = f"own{i}.{j}"
        rows.append((i, " ".join(words), "en", "s", 0, "k", 0))
    for y in range(8):
        words = rows[y][1].split()
        at = 20 + 40 * y
        words[at : at + 33] = [f"y{y}.{j}" for j in range(33)]
        rows.append((size + y, " ".join(words), "en", "s", 0, "k", 0))
    return rows


def test_pairs_beside_a_large_group_are_found(spark):
    rows = template_rows(300, own=6)
    want = brute(rows)
    near = [w for w in want if w[0] >= 300]
    assert any(n < 30 for *_, n in near) and all(n for *_, n in near)
    got = [(r.doc_id, r.class_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(w[:2] for w in want)


def test_links_of_a_large_group_are_counted(spark, monkeypatch):
    if hasattr(jaccard, "TEXTS_A_BLOCK"):  # several blocks
        monkeypatch.setattr(jaccard, "TEXTS_A_BLOCK", 40)
        monkeypatch.setattr(jaccard, "GRAMS_A_BLOCK", 20_000)
    rows = template_rows(120)
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_one_of_each(spark):
    rows = near_rows(6, groups=4)
    want = brute(rows)
    df = frame(spark, rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {w[1] for w in want if w[1] is not None} | {None}
    assert jaccard.near_duplicates(empty(spark)).collect() == [] and jaccard.one_of_each(empty(spark)).collect() == []
    assert SCHEMA
