import random
import re
from pathlib import Path

import pyarrow as pa
import pytest

from rasterloom.llm import common, pieces

from .helpers import awkward, empty, frame

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_same_as_the_library(vocabulary, library):
    rng = random.Random(2)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = ["", " ", "  a b\n c  日本 \t x ", "▁x", "a" * 700, " " * 40 + "y", "🎉🎉\0\0", "x\r\n y", "The quick brown fox's 12345 jumps!"]
    texts += ["".join(rng.choice("ab cdeéß \n日🎉t▁h in") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    tokens, at = vocabulary.encode(texts)
    for text, a, b in zip(texts, at, at[1:]):
        assert tokens[a:b].tolist() == library.encode(text), repr(text)
        assert vocabulary.decode(tokens[a:b]) == text.replace("▁", " ")


def test_documents(spark, library):
    rows = awkward()
    out = pieces.encode_documents(frame(spark))
    got = sorted(((r.doc_id, r.tokens) for r in out.collect()), key=str)
    assert got == sorted(((x[0], library.encode(x[1] or "")) for x in rows), key=str)
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in out.collect())
    back = pieces.decode_documents(out)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((x[0], x[1] or "") for x in rows), key=str)
    assert pieces.encode_documents(empty(spark)).collect() == []


def test_small_batches(vocabulary, library, monkeypatch):
    texts = [x[1] or "" for x in awkward(seed=9)]
    whole, at = vocabulary.encode(texts)
    parts = [vocabulary.encode([x])[0].tolist() for x in texts]
    assert [whole[a:b].tolist() for a, b in zip(at, at[1:])] == parts


def test_null_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, tokens array<int>")
    assert sorted((r.doc_id, r.text) for r in pieces.decode_documents(df).collect()) == [(1, None), (2, "")]


def test_freed_memory_goes_back(spark):
    """What an earlier stage left in a worker, and what a batch took, isn't held on by the worker."""

    def held(batches):
        def mb():
            return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

        kept = [bytes(40_000) + b"x" for _ in range(4000)]
        pin = [bytes(40_000) + b"x" for _ in range(2)]
        before = mb()
        del kept
        freed = []
        for _ in batches:
            common.give_back()
            freed.append(before - mb())
        yield pa.record_batch([pa.array([max(freed)]), pa.array([len(pin)])], names=["mb", "n"])

    got = spark.range(1).coalesce(1).mapInArrow(held, "mb double, n long").first()
    assert got.mb > 100
