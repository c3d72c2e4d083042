"""Small documents with the awkward cases: nulls, empty and long texts, copies, clashing columns."""

import random

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "po", "ra", "si") for b in ("n", "rt", "l", "mmo", "sa", "t")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, and columns whose names the operators use inside)."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(n)]
    texts += [None, "", " \n ", "one", texts[0], texts[0], texts[1], prose(rng, 6000), "日本語 🎉 naïve\0text", "x" * 3000]
    for i in range(4):
        words = texts[2].split() + prose(rng, 300).split()
        words[i * 20] = f"changed{i}"
        texts.append(" ".join(words[:150]) if i else " ".join(words))
    rows = []
    for i, t in enumerate(texts):
        source = None if i % 13 == 5 else "big" if i % 3 == 0 else f"s{i % 4}"
        rows.append((None if i % 29 == 7 else i, t, None if i % 11 == 3 else "en", source, None if t is None else len(t), f"k{i}", i))
    rows.append(rows[0])
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int"


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
