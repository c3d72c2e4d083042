import random

import pytest

from rasterloom.llm import quality

from .helpers import SCHEMA, awkward, empty, frame, prose


def corpus(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, kind = prose(rng, rng.randrange(40, 200)), rng.random()
        q = tox = 0
        if kind < 0.15:
            text = text.upper().replace(" ", "!! ")
        elif kind < 0.3:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyword", "vilething"])
            text, q, tox = " ".join(words), 1, 1
        else:
            q = 1
        docs.append((i, text, "en", f"s{i % 5}", len(text), "k", 0))
        labels.append((i, q, tox))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(3, 700)
    known = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id bigint, quality int, toxic int")
    df = frame(spark, docs)
    got = {r.doc_id: r for r in quality.score_documents(df, known).collect()}
    right = [got[i].keep == (q == 1 and t == 0) for i, q, t in labels if i % 2]
    assert sum(right) / len(right) > 0.95
    kept = {r.doc_id for r in quality.clean_documents(df, known).collect()}
    assert kept == {i for i, r in got.items() if r.keep}
    assert {r.doc_id: r for r in quality.score_documents(df.repartition(7), known).collect()} == got


def test_awkward_rows(spark):
    docs, labels = corpus(4, 200)
    known = spark.createDataFrame([*labels, (3, None, None), (None, 1, 0), (labels[0][0], 1 - labels[0][1], 0)], "doc_id bigint, quality int, toxic int")
    rows = docs + [(1000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(awkward())]
    df = frame(spark, rows)
    got = quality.score_documents(df, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.clean_documents(df, known).schema == df.schema


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_both_labels_all_stay(spark, labels):
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = frame(spark)
    assert all(r.keep and r.score == 1 for r in quality.score_documents(df, known).collect())
    assert quality.clean_documents(df, known).count() == df.count()
    assert quality.score_documents(empty(spark), known).collect() == []


def test_no_such_columns(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert quality.score_documents(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).first().keep
    assert SCHEMA
