"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, prefix_hash, span_hash

#: At most about so many labelled and unlabelled rows are fitted on, chosen by a hash of the id.
LABELLED_ROWS, POOL_ROWS = 12_000, 4_000
ROUNDS, CONFIDENT, PSEUDO_WEIGHT, HELD_OUT = 3, 0.98, 0.3, 5
DIMS = 1 << 20
LEAST_DOCS, LEAST_Z = 4, 4.0
META = ("log_bytes", "lines", "line_bytes", "upper", "digits", "symbols", "space", "high", "word_bytes", "repeated_lines")

_letter = np.zeros(256, bool)
_letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_symbol = ~_letter & (np.arange(256) > 32)


def text_view(raw: bytes) -> np.ndarray:
    """Hashed distinct words (letters and digits, ASCII in lower case), their beginnings of 4 and 5 bytes, and symbol runs of a whole text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int32)
    lower = _lower[data]
    prefix = prefix_hash(lower)
    out = []
    for salt, mask in ((0, _letter[data]), (1, _symbol[data])):
        edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spans = [(start, end)] + [(start[end - start > k], start[end - start > k] + k) for k in (4, 5) if not salt]
        for i, (a, b) in enumerate(spans):
            out.append((span_hash(prefix, a, b) >> np.uint64(20 + salt + 2 * i)).astype(np.int64) & (DIMS - 1))
    return np.unique(np.concatenate(out)).astype(np.int32)


def page_view(raw: bytes, source: str | None, lang: str | None) -> np.ndarray:
    """Layout figures, and hashed source and language, of a document."""
    data = np.frombuffer(raw, np.uint8)
    n = max(len(data), 1)
    letters = _letter[data]
    words = max(1, int((np.diff(letters.astype(np.int8)) == 1).sum()) + bool(len(data) and letters[0]))
    lines = raw.split(b"\n")
    figures = [
        np.log1p(len(data)), np.log1p(len(lines)), np.log1p(n / len(lines)), ((data >= 65) & (data <= 90)).sum() / n, ((data >= 48) & (data <= 57)).sum() / n,
        _symbol[data].sum() / n, (data <= 32).sum() / n, (data >= 128).sum() / n, np.log1p(letters.sum() / words), 1 - len(set(lines)) / len(lines)]
    hot = np.zeros(16 + 8)
    hot[sum((source or "").encode()) % 16] = 1
    hot[16 + sum((lang or "").encode()) % 8] = 1
    return np.concatenate([figures, hot])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def joint(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One column: the log-odds of a document that both calibrated views hold clean, each on its own."""
    clean = sigmoid(t) * sigmoid(p)
    return (np.log(clean + 1e-12) - np.log(1 - clean + 1e-12))[:, None]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps on few columns."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    total = weight.sum()
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) / total + ridge * w
        curve = (x.T * (weight * p * (1 - p))) @ x / total + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def parts(n: int, size: int = 1 << 20) -> list[slice]:
    return [slice(at, at + size) for at in range(0, n, size)]


class TextView:
    """A log-odds model of the words that tell the labels apart."""

    def fit(self, flat: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> TextView:
        n = len(y)
        bad, good = np.zeros(DIMS), np.zeros(DIMS)
        for p in parts(len(flat)):  # a part at a time, since the words are many
            w, label = weight[rows[p]], y[rows[p]]
            bad += np.bincount(flat[p], weights=w * (1 - label), minlength=DIMS)
            good += np.bincount(flat[p], weights=w * label, minlength=DIMS)
        n_bad, n_good = (weight * (1 - y)).sum(), (weight * y).sum()
        p_bad, p_good = (bad + 0.2) / (n_bad + 0.4), (good + 0.2) / (n_good + 0.4)
        odds = np.log(p_good) - np.log(p_bad)
        z = np.abs(odds) / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        self.weights = np.where((bad + good >= LEAST_DOCS) & (z >= LEAST_Z * 0.5), odds, 0.0)
        strong = z >= LEAST_Z
        self.strong = np.where(strong & (bad + good >= LEAST_DOCS), odds, 0.0)
        self.scale = logistic(self.columns(flat, rows, n), y, weight, ridge=1e-2)
        return self

    def columns(self, flat: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the words' evidence on each side, all and strong words apart, and the strongest bad word."""
        sums, worst = np.zeros((4, n)), np.zeros(n)
        for p in parts(len(flat)):
            w, s, r = self.weights[flat[p]], self.strong[flat[p]], rows[p]
            for total, v in zip(sums, (np.minimum(w, 0), np.maximum(w, 0), np.minimum(s, 0), np.maximum(s, 0)), strict=True):
                total += np.bincount(r, weights=v, minlength=n)
            np.minimum.at(worst, r, s)
        return np.column_stack([np.clip(sums[0], -60, 0) / 10, np.clip(sums[1], 0, 60) / 10, np.clip(sums[2], -20, 0) / 4, np.clip(sums[3], 0, 20) / 4, worst])

    def margin(self, flat: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return self.columns(flat, rows, n) @ self.scale[:-1] + self.scale[-1]


class PageView:
    """Logistic regression on the layout figures, with their squares."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> PageView:
        own = x[weight > 0]
        self.mean, self.std = own.mean(axis=0), own.std(axis=0) + 1e-6
        self.w = logistic(self.columns(x), y, weight, ridge=3e-3)
        return self

    def columns(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([z, z[:, : len(META)] ** 2])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.columns(x) @ self.w[:-1] + self.w[-1]


def fit(flat: np.ndarray, rows: np.ndarray, pages: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> dict | None:
    """Co-trains both views; labels are 1, 0 or -1 (unknown). None where a label is missing.

    In each round, each view labels the unknown rows that it is confident of, for the other
    view; labelled rows of the held-out fold are used only to calibrate the views (Platt)
    and to weigh their calibrated log-odds.
    """
    n = len(labels)
    held = (labels >= 0) & (folds == 0)
    train = (labels >= 0) & ~held
    if min((train & (labels == v)).sum() for v in (0, 1)) == 0:
        return None
    if min((held & (labels == v)).sum() for v in (0, 1)) < 3:  # too few to hold out
        held = train = labels >= 0
    text, page = TextView(), PageView()
    extra_t, extra_p = np.full(n, -1), np.full(n, -1)  # the pseudo-labels that each view is given

    def refit() -> None:
        for given, make in ((extra_t, lambda y, w: text.fit(flat, rows, y, w)), (extra_p, lambda y, w: page.fit(pages, y, w))):
            y = np.where(train, labels, np.maximum(given, 0)).astype(float)
            make(y, np.where(train, 1.0, np.where(given >= 0, PSEUDO_WEIGHT, 0.0)))

    def calibrated() -> tuple[np.ndarray, np.ndarray, list]:
        out, how = [], []
        for m in (text.margin(flat, rows, n), page.margin(pages)):
            a = logistic(m[held, None], labels[held].astype(float), np.ones(held.sum()), ridge=1e-4)
            out.append(m * a[0] + a[1])
            how.append(a)
        return out[0], out[1], how

    refit()
    for _ in range(ROUNDS):
        t, p, _ = calibrated()
        unknown = labels < 0
        edge = np.log(CONFIDENT / (1 - CONFIDENT))
        extra_p = np.where(unknown & (t > edge), 1, np.where(unknown & (t < -edge), 0, extra_p))
        extra_t = np.where(unknown & (p > edge), 1, np.where(unknown & (p < -edge), 0, extra_t))
        refit()
    t, p, how = calibrated()
    both = logistic(joint(t, p)[held], labels[held].astype(float), np.ones(held.sum()), ridge=1e-4)
    used = np.flatnonzero(text.weights)
    return {"used": used.astype(np.int32), "weights": text.weights[used], "strong": text.strong[used], "scale": text.scale, "mean": page.mean, "std": page.std, "page": page.w, "how": how, "both": both}


def views(df: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id and the columns in ``keep``, with both views' features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            raws = [x or b"" for x in c["_raw"].to_pylist()]
            meta = [page_view(r, s, g) for r, s, g in zip(raws, c["_source"].to_pylist(), c["_lang"].to_pylist(), strict=True)]
            yield pa.record_batch([*(c[k] for k in keep), pa.array([text_view(r) for r in raws], pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.float64()))], names=[*keep, "words", "page"])

    kinds = {"doc_id": "bigint", "_y": "int", "_fold": "int"}
    return df.select(*keep, "_raw", "_source", "_lang").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", words array<int>, page array<double>")


def train(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS) -> dict | None:
    """Fits on a bounded sample; documents as from ``_plain``."""
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("_y")).filter("_y is not null and doc_id is not null").groupBy("doc_id").agg(F.min("_y").alias("_y"))
    n_labels, n_docs = wanted.count(), documents.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    wanted = wanted.filter(place < min(1.0, labelled_rows / max(n_labels, 1)))
    pool = documents.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30) < min(1.0, pool_rows / max(n_docs, 1)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(HELD_OUT)).cast("int").alias("_fold")
    known = documents.join(wanted, "doc_id").select("doc_id", "_y", fold, "_raw", "_source", "_lang")
    unknown = pool.join(wanted, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("_y"), fold, "_raw", "_source", "_lang")
    # the sample is small enough for one task, so the driver gets the fitted weights alone
    feats = views(known.unionByName(unknown), ["doc_id", "_y", "_fold"]).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_rows(list(batches))
        yield pa.record_batch([pa.array([None if model is None else pickle.dumps(model)], pa.binary())], names=["model"])

    found = feats.mapInArrow(run, "model binary").filter("model is not null").first()
    return None if found is None else pickle.loads(found["model"])


def fit_rows(batches: list[pa.RecordBatch]) -> dict | None:
    """``fit`` on rows of ``views``."""
    if not sum(b.num_rows for b in batches):
        return None
    got = pa.Table.from_batches(batches)
    y, folds = got.column("_y").to_numpy().astype(int), got.column("_fold").to_numpy()
    pages = got.column("page").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    # words of very few documents are dropped before anything else is made of them
    chunks = got.column("words").chunks
    often = sum(np.bincount(c.flatten().to_numpy(), minlength=DIMS) for c in chunks) >= LEAST_DOCS
    flat, rows, at = [], [], 0
    for c in chunks:
        words, sizes = c.flatten().to_numpy(), np.diff(c.offsets.to_numpy())
        keep = often[words]
        flat.append(words[keep])
        rows.append(np.repeat(np.arange(at, at + len(c), dtype=np.int32), sizes)[keep])
        at += len(c)
    # in one order, whatever the partitions
    order = np.lexsort((pages[:, 0], y, got.column("doc_id").to_numpy()))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    flat, rows = np.concatenate(flat), place[np.concatenate(rows)]
    del got, chunks, batches  # only the pruned words are needed from here on
    by_row = np.argsort(rows, kind="stable")
    return fit(flat[by_row], rows[by_row], pages[order], y[order], folds[order])


def _plain(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    have = set(documents.columns)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_raw"), *((F.col(n).cast("string") if n in have else F.lit(None).cast("string")).alias(f"_{n}") for n in ("source", "lang")))


def scorer(model: dict | None):
    """A function from whole texts, sources and languages to (text score, page score, score): probabilities of being clean."""
    if model is None:
        return lambda raws, sources, langs: tuple(np.ones(len(raws)) for _ in range(3))
    text, page = TextView(), PageView()
    text.weights, text.strong = np.zeros(DIMS), np.zeros(DIMS)
    text.weights[model["used"]], text.strong[model["used"]], text.scale = model["weights"], model["strong"], model["scale"]
    page.mean, page.std, page.w = model["mean"], model["std"], model["page"]

    def score(raws: list[bytes], sources: list, langs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [text_view(r) for r in raws]
        n = len(raws)
        rows = np.repeat(np.arange(n), [len(w) for w in words])
        t = text.margin(np.concatenate(words) if n else np.zeros(0, np.int32), rows, n)
        p = page.margin(np.array([page_view(*x) for x in zip(raws, sources, langs, strict=True)]).reshape(n, -1))
        (a, b), (c, d) = model["how"]
        t, p = t * a + b, p * c + d
        return sigmoid(t), sigmoid(p), sigmoid(joint(t, p) @ model["both"][:-1] + model["both"][-1])

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, page_score, score and keep for each document: high quality and not toxic, or not.

    Labels (doc_id, quality, toxic): a document is clean if quality is 1 and toxic is not 1;
    with several labels of a document, it must be clean by all; rows whose both labels are
    null don't count. Without labels of both kinds (an empty table, too), each document
    scores 1 and is kept. A null text counts as empty, null source and language as ''.
    Repeated rows score alike. Only doc_id, text, source and lang are read.
    """
    plain = _plain(documents)
    model = documents.sparkSession.sparkContext.broadcast(train(plain, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                t, p, s = score([x or b"" for x in part.column(1).to_pylist()], part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(np.round(t, 6)), pa.array(np.round(p, 6)), pa.array(np.round(s, 6)), pa.array(s >= threshold)], names=["doc_id", "text_score", "page_score", "score", "keep"])

    return plain.select("doc_id", "_raw", "_source", "_lang").mapInArrow(run, "doc_id bigint, text_score double, page_score double, score double, keep boolean")


def clean_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with their columns; one pass over the texts.

    Null and empty texts are scored as empty ones, repeated rows alike; an empty table gives
    an empty one, and without labels of both kinds all documents stay.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(_plain(documents), labels))
    columns, at = documents.columns, {n: i for i, n in enumerate(documents.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts, none = part.column(at["text"]).cast(pa.binary()).to_pylist(), [None] * part.num_rows
                source, lang = (part.column(at[n]).cast(pa.string()).to_pylist() if n in at else none for n in ("source", "lang"))
                yield part.filter(pa.array(score([x or b"" for x in texts], source, lang)[2] >= threshold))

    return documents.select(*columns).mapInArrow(run, documents.schema)
