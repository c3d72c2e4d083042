"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gram_hashes, mix, word_hashes, written

WORDS, SIMILARITY = 5, 0.8
COORDINATES, SMALL = 48, 32
#: Runs are repeated until a pair of the similarity is found with this probability.
RECALL = 1 - 1e-8
#: Pairs whose estimate from all coordinates is lower are not computed exactly; at 0.8 that meets one in 10**9.
LEAST_ESTIMATE = 0.4
#: What two blocks of a group hold at most, about, when they meet.
TEXTS_A_BLOCK, GRAMS_A_BLOCK, COLUMNS_AT_ONCE = 1000, 500_000, 2048
#: Up to so many 16-byte keys are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

_salts = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def grams(raw: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of k words; of all its words where there are fewer; none without words."""
    words = word_hashes(np.frombuffer(raw, np.uint8))[0]
    return np.unique(gram_hashes(words, min(k, max(len(words), 1))))


def runs_for(similarity: float, recall: float = RECALL) -> int:
    """The least number of runs of which one at least finds a pair of that similarity with the wanted probability."""
    runs = 1
    while (1 - similarity) ** runs > 1 - recall and runs < COORDINATES:
        runs += 1
    return runs


def sample(g: np.ndarray) -> bytes:
    """The sampled tokens of a set: for each coordinate its smallest hash, as 32 bits."""
    out = np.empty(COORDINATES, np.uint64)
    for i in range(COORDINATES):
        x = (g ^ _salts[i]) * _salts[i]
        out[i] = (x ^ (x >> np.uint64(32))).min()
    return (mix(out) >> np.uint64(32)).astype("<u4").tobytes()


def text_key(column) -> object:
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def samples(documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, key, n_grams, tokens) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(x or b"", k) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(g) for g in sets], pa.int64()), pa.array([sample(g) if len(g) else None for g in sets], pa.binary())], names=["doc_id", "key", "n_grams", "tokens"])

    plain = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("raw"))
    return plain.mapInArrow(run, "doc_id bigint, key binary, n_grams bigint, tokens binary")


def token(tokens, coordinate: int):
    return F.substring(tokens, 4 * coordinate + 1, 4)


def meetings(rows: DataFrame, compare: Callable, columns: list[str]) -> DataFrame:
    """(key, root, n_links): each text that ``compare`` links to others, with a text that its links lead to and their number.

    ``rows`` has group, key, blocks and the columns to compare. Each group is dealt into so
    many blocks by its keys' hashes, and each two blocks meet once, in a task of their own,
    so a large group's pairs are neither left out nor made into rows. A text has a row for
    each meeting in which it has links.
    """

    def result(links: np.ndarray, keys: list) -> tuple[list, list, list]:
        label, n = joined(links), links.sum(axis=1)
        linked = np.flatnonzero(n)
        return [keys[i] for i in linked], [keys[label[i]] for i in linked], n[linked].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [])
        place, held = None, []

        def close() -> None:
            if len(held) > 1:
                first = sum(not r[0] for r in held)
                values = [[r[i] for r in held] for i in range(2, 2 + len(columns))]
                links = np.zeros((len(held), len(held)), bool)
                if place[1] == place[2]:
                    links[:] = compare(*values, *values)
                    np.fill_diagonal(links, False)
                elif 0 < first < len(held):
                    links[:first, first:] = compare(*(v[:first] for v in values), *(v[first:] for v in values))
                    links |= links.T
                for x, y in zip(out, result(links, [r[1] for r in held]), strict=True):
                    x.extend(y)

        def rows_out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["key", "root", "n_links"])

        for batch in batches:
            for group, low, high, *r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, low, high) != place:
                    close()
                    place, held = (group, low, high), []
                    if len(out[0]) > 10_000:
                        yield rows_out()
                        out = ([], [], [])
                if not held or held[-1][1] != r[1]:  # a copy's row may be there twice
                    held.append(r)
        close()
        yield rows_out()

    at = F.pmod(F.xxhash64(F.lit("block"), "key"), "blocks")
    met = rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("group", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), (F.col("at") > F.col("other")).alias("side"), "key", *columns)
    return met.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "side", "key").mapInArrow(run, "key binary, root binary, n_links bigint")


def joined(links: np.ndarray) -> np.ndarray:
    """The least index that each one's links lead to."""
    label = np.arange(len(links))
    while True:
        step = np.minimum(label, np.where(links, label, len(links)).min(axis=1, initial=len(links)))
        step = step[step]
        if (step == label).all():
            return label
        label = step


def likely_links(similarity: float) -> Callable:
    """Compares two lists of samples: whose sizes allow the similarity and whose estimates are not far below it."""

    def compare(n_a: list, tokens_a: list, n_b: list, tokens_b: list) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(t), "<u4").reshape(-1, COORDINATES) for t in (tokens_a, tokens_b))
        equal = np.zeros((len(x), len(y)), np.uint8)
        for i in range(COORDINATES):
            equal += x[:, i, None] == y[None, :, i]
        n, m = np.array(n_a)[:, None], np.array(n_b)[None, :]
        return (equal >= LEAST_ESTIMATE * COORDINATES) & (np.minimum(n, m) >= similarity * np.maximum(n, m))

    return compare


def exact_similarity(similarity: float) -> Callable:
    """Compares two lists of whole sets."""

    def compare(sets_a: list, sets_b: list) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in sets_a + sets_b]
        size, n = np.array([len(x) for x in sets]), len(sets_a)
        held, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, often = np.repeat(np.arange(len(sets)), size), times > 1
        row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, len(sets) - n), np.float32)
        for at in range(0, int(often.sum()), COLUMNS_AT_ONCE):
            low, high = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
            has = np.zeros((len(sets), int(column[high - 1]) - at + 1), np.float32)
            has[row[low:high], column[low:high] - at] = 1
            common += has[:n] @ has[n:].T
        common = common.astype(np.float64)
        return common / (size[:n, None] + size[None, n:] - common) >= similarity

    return compare


def candidates(texts: DataFrame, similarity: float, small: int = SMALL) -> DataFrame:
    """Links (a, b), a < b, whose connected components hold the pairs that are likely similar.

    Each run splits the texts by a token sampled from their sets, one coordinate a run, and
    all pairs of a bucket are compared by their samples: as rows in buckets of up to ``small``
    texts, else in blocks, which give a link for each text instead of each pair. No text
    leaves a bucket. A pair of similarity s is in no common bucket with probability
    (1 - s)**runs; runs are repeated until that is under 1 - RECALL (12 runs, 4e-9, at 0.8).
    """
    runs = runs_for(similarity)
    rows = texts.select("key", F.explode(F.array(*[F.xxhash64(F.lit(r), token("tokens", r)) for r in range(runs)])).alias("path"))
    rows = written(rows, "paths")
    met = written(rows.join(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "path"), "buckets")
    few = met.filter(F.col("n") <= small).groupBy("path").agg(F.sort_array(F.collect_set("key")).alias("k"))
    few = few.select(F.explode(F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    a, b = (texts.select(F.col("key").alias(s), F.col("n_grams").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    likely = few.distinct().join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    likely = likely.filter(agreement("tokens_a", "tokens_b") >= LEAST_ESTIMATE * COORDINATES).select("a", "b")
    large = met.filter(F.col("n") > small).select("key", F.col("path").alias("group"), F.ceil(F.col("n") / TEXTS_A_BLOCK).alias("blocks"))
    large = large.join(texts.select("key", "n_grams", "tokens"), "key")
    return written(likely.unionByName(star(meetings(large, likely_links(similarity), ["n_grams", "tokens"]))), "likely")


def star(rooted: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of texts to their roots."""
    return rooted.filter("key != root").select(F.least("key", "root").alias("a"), F.greatest("key", "root").alias("b")).distinct()


def agreement(a: str, b: str):
    """On how many coordinates two samples agree."""
    return reduce(add, ((token(F.col(a), i) == token(F.col(b), i)).cast("int") for i in range(COORDINATES)))


def exact_links(documents: DataFrame, texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """(key, root, n_links) of texts whose Jaccard similarity to others with the same label, computed from whole texts, is high enough."""
    # of copies, the row of least id is read
    keys = written(labels.join(texts.select("key", "n_grams", "rep"), "key"), "likely-keys")
    weight = F.sum(F.col("n_grams") + GRAMS_A_BLOCK // TEXTS_A_BLOCK)
    many = keys.groupBy("label").agg(F.ceil(weight / GRAMS_A_BLOCK).alias("blocks")).filter("blocks > 1")
    keys = keys.join(F.broadcast(many) if many.count() <= BROADCAST_KEYS else many, "label", "left")
    keys = keys.select(F.col("key").alias("_key"), "rep", F.col("label").alias("group"), F.coalesce("blocks", F.lit(1).cast("bigint")).alias("blocks"))
    whole = documents.select(F.col(id_col).cast("bigint").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("raw"))
    whole = whole.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("rep"))).select("key", "group", "blocks", "raw")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], pa.array([grams(x or b"", k).tobytes() for x in batch.column(3).to_pylist()], pa.binary())], names=["key", "group", "blocks", "grams"])

    held = written(whole.mapInArrow(sets, "key binary, group binary, blocks bigint, grams binary"), "gram-sets")
    return meetings(held, exact_similarity(similarity), ["grams"])


def classes(links: DataFrame) -> DataFrame:
    """(key, label) of the links' connected components: each label is the least key.

    Each round, each component (at first, each text) goes over to the least one that it is
    linked with, or on to where that one goes, and the links between components that have
    met vanish, so the links that are left get fewer fast.
    """
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).distinct()
    labels, left = written(ends.select("key", F.col("key").alias("label")), "labels"), links.select("a", "b")
    while True:
        to = left.groupBy(F.greatest("a", "b").alias("at")).agg(F.min(F.least("a", "b")).alias("to"))
        to = written(to, "hooks")
        if not to.limit(1).count():
            return labels
        while True:  # pointer jumping, until each hook leads to its end
            on = to.select(F.col("at").alias("to"), F.col("to").alias("on"))
            step = written(to.join(on, "to", "left").select("at", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved")), "hooks")
            to = step.select("at", "to")
            if not step.filter("moved").limit(1).count():
                break
        labels = written(labels.join(to.withColumnRenamed("at", "label"), "label", "left").select("key", F.coalesce("to", "label").alias("label")), "labels")
        left = left.join(to.select(F.col("at").alias("a"), F.col("to").alias("to_a")), "a", "left").select(F.coalesce("to_a", "a").alias("a"), "b")
        left = left.join(to.select(F.col("at").alias("b"), F.col("to").alias("to_b")), "b", "left").select("a", F.coalesce("to_b", "b").alias("b"))
        left = written(left.filter("a != b").distinct(), "edges")


def near_duplicates(documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's class of near duplicates: doc_id, class_id, n_links.

    Two texts are linked if the Jaccard similarity of their sets of ``words`` successive
    words (white space divides words; case counts) is ``similarity`` or more. Texts with
    fewer words have one set element, all of them; texts without words are linked to none.
    Equal texts are in one class without a link. class_id is the least id in the class;
    n_links counts the different texts that the row's text is linked to. Pairs in buckets of up
    to ``small`` texts are compared as rows, those in larger ones in blocks.
    Null texts count as empty. Rows with a null id have a class, too (null, if it has no
    other). An empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(documents.sparkSession)
    read = written(samples(documents, id_col, text_col, words), "samples")
    texts = written(read.filter("n_grams > 0").groupBy("key").agg(F.first("n_grams").alias("n_grams"), F.first("tokens").alias("tokens"), F.min("doc_id").alias("rep")), "texts")
    likely = classes(candidates(texts, similarity, small))
    links = written(exact_links(documents, texts, likely, id_col, text_col, words, similarity), "links")
    label = classes(written(star(links), "edges"))
    degree = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    firsts = read.groupBy("key").agg(F.min("doc_id").alias("first"))
    firsts = written(firsts.join(label, "key", "left").join(degree, "key", "left").select("key", "first", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "members")
    least = firsts.groupBy("label").agg(F.min("first").alias("class_id"))
    return read.select("doc_id", "key").join(firsts.join(least, "label").select("key", "class_id", "n_links"), "key").select("doc_id", "class_id", "n_links")


def one_of_each(documents: DataFrame, **how) -> DataFrame:
    """The documents of which the class has no row with a smaller id; rows with a null id stay.

    Null, empty and wordless texts are a class for each different text; rows that share the
    least id all stay. An empty table gives an empty one; the columns stay as they are.
    """
    kept = near_duplicates(documents, **how).filter("doc_id = class_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    # the texts are not exchanged, if the ids are few enough to be broadcast
    n = kept.count()
    first = documents.join(F.broadcast(kept) if n <= BROADCAST_KEYS else kept, F.col("doc_id").cast("bigint") == F.col("_kept_id"), "left_semi")
    return first.unionByName(documents.filter("doc_id is null"))


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x01-\\x20]+'), lambda w: w <> '') as w from documents),
 u as (select text, any_value(w) as w, min(doc_id) as first from t group by text),
 g as (select first, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) as gram from u where len(w) > 0),
 n as (select first, count(*) as n from g group by first),
 c as (select a.first as a, b.first as b, count(*) as k from g a join g b using (gram) where a.first <> b.first group by a.first, b.first),
 l as (select a, b from c join n x on x.first = a join n y on y.first = b where k::double / (x.n + y.n - k) >= 0.8),
 r as (with recursive r(x, y) as (select first, first from u union select r.x, l.b from r join l on l.a = r.y) select x, min(y) as class_id from r group by x),
 d as (select a, count(*) as n_links from l group by a)
select t.doc_id, r.class_id, coalesce(d.n_links, 0) as n_links from t join u using (text) join r on r.x = u.first left join d on d.a = u.first"""
