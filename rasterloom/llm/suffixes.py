"""Removal of repeated byte strings: suffix arrays by two-stage sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, prefix_hash, span_hash, window_minima, written

LENGTH, GRAM, PARTS = 400, 16, 3
BLOCK_BYTES = 1_000_000
#: Cores with more contexts than this are compared window by window instead of in one task.
HOT_CONTEXTS = 20_000
BROADCAST_KEYS = 200_000
SEAM, END = 0xFF, 0xFE  # bytes that UTF-8 never has


def eight_bytes(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place as a number, zeros beyond the end; for ``depth`` places more than there are bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    words = np.zeros(n + depth, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + n + depth]
    return words


def sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the bytes from there, eight at a time; only what is equal so far is sorted further. Equal ones keep their order."""
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for off in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = np.flatnonzero(tied)
        if not len(live):
            break
        key, first = words[at[live] + off], np.flatnonzero(new[live])
        # most groups go on alike, as copies do, and stay in their order
        unlike = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
        sizes = np.diff(np.concatenate([first, [len(live)]]))
        part = np.repeat(unlike, sizes)
        live, key, group = live[part], key[part], np.repeat(np.arange(len(first)), sizes)[part]
        order = np.lexsort((key, group))
        at[live], key = at[live][order], key[order]
        new[live[1:]] |= key[1:] != key[:-1]
    return at


def two_stage_suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``data``, sorted by their first ``depth`` bytes at least.

    Suffixes smaller than their successors are sorted directly. Each other suffix is greater
    than its successor, so a scan of the buckets in rising order meets the successor first:
    the suffix goes to the next free place of its first byte's bucket. A bucket is scanned
    as a whole; runs of its own byte need a pass for each byte of the longest run.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller than the successor: by the next differing byte; a run up to the end is greater than its rest
    change = np.flatnonzero(data[1:] != data[:-1])
    smaller = np.zeros(n, bool)
    if len(change):
        at = np.searchsorted(change, np.arange(n))
        inside = at < len(change)
        edge = change[at[inside]]
        smaller[inside] = data[edge] < data[edge + 1]
    direct = sorted_directly(eight_bytes(data, depth), np.flatnonzero(smaller)[::-1], depth)
    counts = np.bincount(data, minlength=256)
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(n, -1, np.int64)
    # direct suffixes end their buckets
    first = data[direct]
    per = np.bincount(first, minlength=256)
    at = np.concatenate([[0], np.cumsum(per)])
    for c in np.flatnonzero(per):
        out[starts[c + 1] - per[c] : starts[c + 1]] = direct[at[c] : at[c + 1]]
    free = starts[:-1].copy()
    # the last suffix has the empty one as its successor, which is before all
    out[free[data[n - 1]]] = n - 1
    free[data[n - 1]] += 1
    for c in np.flatnonzero(counts):
        scanned = starts[c]
        while True:
            stop = free[c]
            if scanned == stop:
                break
            run = out[scanned:stop] - 1
            scanned = stop
            run = run[run >= 0]
            run = run[(data[run] == c) & ~smaller[run]]
            out[free[c] : free[c] + len(run)] = run
            free[c] += len(run)
        whole = out[starts[c] : starts[c + 1]] - 1
        whole = whole[whole >= 0]
        whole = whole[(data[whole] > c) & ~smaller[whole]]
        if len(whole):
            head = data[whole]
            order = np.argsort(head, kind="stable")
            head, whole = head[order], whole[order]
            b, first_at, number = np.unique(head, return_index=True, return_counts=True)
            place = np.repeat(free[b] - first_at, number) + np.arange(len(whole))
            out[place] = whole
            free[b] += number
    return out


def common_prefixes(data: np.ndarray, suffixes: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """How many bytes each suffix shares with the one before it, up to ``depth``; 0 where ``wanted`` (by place) leaves one of them out."""
    words, common = eight_bytes(data, depth), np.zeros(len(suffixes), np.int64)
    live = np.arange(1, len(suffixes)) if wanted is None else 1 + np.flatnonzero(wanted[suffixes[1:]] & wanted[suffixes[:-1]])
    a, b = suffixes[live], suffixes[live - 1]
    for off in range(0, depth, 8):
        other = words[a + off] ^ words[b + off]
        unlike = other != 0
        common[live[unlike]] = off + sum((other[unlike] >> np.uint64(56 - 8 * j) == 0).astype(np.int64) for j in range(8))
        live, a, b = live[~unlike], a[~unlike], b[~unlike]
    common[live] = depth
    common[1:] = np.minimum(common[1:], len(data) - np.maximum(suffixes[1:], suffixes[:-1]))
    return np.minimum(common, depth)


class Shape:
    """How windows of ``length`` bytes are found by cores.

    A window holds the least hash of its GRAM-byte strings; that place, less 0, s or 2 s,
    begins a core of length - s + 1 bytes which lies in the window, at most s - 1 after its
    start. Equal windows have equal cores at equal places, so they differ, if at all, only
    in the s - 1 bytes before and behind the core: its context.
    """

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, max(1, min(GRAM, length // 4))
        self.w = length - self.gram + 1
        self.s = -(-self.w // PARTS)
        self.core = length - self.s + 1

    def cores(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the cores, their hashes, and hashes with their contexts."""
        n = len(data)
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        p = prefix_hash(data)
        at = np.arange(n - self.gram + 1)
        least = window_minima(span_hash(p, at, at + self.gram), self.w)
        c = np.unique((least[:, None] - self.s * np.arange(PARTS)[None, :]).ravel())
        c = c[(c >= 0) & (c + self.core <= n)]
        low, high = np.maximum(c - self.s + 1, 0), np.minimum(c + self.core + self.s - 1, n)
        around = span_hash(p, low, high) + (c - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return c, span_hash(p, c, c + self.core), mix(around)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def text_key(column) -> object:
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def core_rows(texts: DataFrame, shape: Shape) -> DataFrame:
    """(key, core, around, n, at) for each different core and context of a text; n: how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                which, columns = [], [[], [], [], []]
                for i, raw in enumerate(part.column(1).to_pylist()):
                    c, core, around = shape.cores(np.frombuffer(raw or b"", np.uint8))
                    if len(c):
                        _, first, n = np.unique(around, return_index=True, return_counts=True)
                        which.append(np.full(len(first), i))
                        for column, x in zip(columns, (core[first], around[first], n, c[first]), strict=True):
                            column.append(x)
                if which:
                    core, around, n, at = (np.concatenate(x) for x in columns)
                    yield pa.record_batch([part.column(0).take(pa.array(np.concatenate(which))), signed(core), signed(around), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=["key", "core", "around", "n", "at"])

    return texts.select("key", "raw").mapInArrow(run, "key binary, core bigint, around bigint, n int, at int")


def contexts(wanted: DataFrame, shape: Shape) -> DataFrame:
    """(core, around, before, after) from texts (raw) with their wanted cores (list)."""
    s, core = shape.s, shape.core

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 50):
                part = batch.slice(begin, 50)
                cores, arounds, before, after = [], [], [], []
                for raw, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for r in rows:
                        c = r["at"]
                        cores.append(r["core"])
                        arounds.append(r["around"])
                        before.append(raw[max(c - s + 1, 0) : c])
                        after.append(raw[c + core : c + core + s - 1])
                yield pa.record_batch([pa.array(cores, pa.int64()), pa.array(arounds, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["core", "around", "before", "after"])

    return wanted.select("raw", "list").mapInArrow(run, "core bigint, around bigint, before binary, after binary")


def repeated_windows(block: list[tuple[int, bytes, bytes]], s: int) -> list[np.ndarray]:
    """For contexts (group, before, after), which of the s windows (by the bytes taken from before) another context of the group has, too.

    All are laid one behind the other, with the seam and the group's number in the core's
    place; a window of the text then is a string of s + 4 bytes over the seam.
    """
    depth = s + 4
    parts, seams, at = [], np.zeros(len(block), np.int64), 0
    for i, (group, before, after) in enumerate(block):
        code = bytes((group >> 7 * j) & 127 for j in range(4))
        parts += [before, b"\xff", code, after, b"\xfe"]
        seams[i] = at + len(before)
        at += len(before) + 6 + len(after)
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])  # windows begin before a seam or at it
    wanted = np.repeat(np.arange(len(sizes)) % 5 < 2, sizes)
    suffixes = two_stage_suffix_array(data, depth)
    same = common_prefixes(data, suffixes, depth, wanted) >= depth
    twice = np.zeros(len(data) + s, bool)
    twice[suffixes[same]] = True
    twice[suffixes[np.flatnonzero(same) - 1]] = True
    out = []
    for seam, (_, before, after) in zip(seams.tolist(), block, strict=True):
        mask = np.zeros(s, bool)
        low, high = max(0, s - 1 - len(after)), min(s - 1, len(before))
        if low <= high:  # t bytes before the seam, s - 1 - t behind the core
            mask[low : high + 1] = twice[seam - high : seam - low + 1][::-1]
        out.append(mask)
    return out


def compared(rows: DataFrame, shape: Shape, block_bytes: int) -> DataFrame:
    """(core, around, mask) from rows that come sorted by core."""
    s = shape.s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, size, group, last = [], [], 0, 0, None

        def result() -> pa.RecordBatch:
            masks = repeated_windows(block, s)
            found = [i for i, m in enumerate(masks) if m.any()]
            return pa.record_batch([pa.array([ids[i][0] for i in found], pa.int64()), pa.array([ids[i][1] for i in found], pa.int64()), pa.array([np.packbits(masks[i]).tobytes() for i in found], pa.binary())], names=["core", "around", "mask"])

        for batch in batches:
            for core, around, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if core != last:
                    if size >= block_bytes:
                        yield result()
                        block, ids, size, group = [], [], 0, 0
                    last, group = core, group + 1
                block.append((group, before, after))
                ids.append((core, around))
                size += len(before) + len(after) + 6
        if block:
            yield result()

    return rows.select("core", "around", "before", "after").mapInArrow(run, "core bigint, around bigint, mask binary")


def compared_by_window(rows: DataFrame, shape: Shape) -> DataFrame:
    """The same for cores with very many contexts: windows are counted by their hashes, pre-aggregated before the exchange."""
    s = shape.s

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                which, ts, hashes, more = [], [], [], []
                for i, (before, after) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    data = np.frombuffer(before + b"\xff" + after, np.uint8)
                    t = np.arange(max(0, s - 1 - len(after)), min(s - 1, len(before)) + 1)
                    p, back = prefix_hash(data), prefix_hash(data[::-1])
                    begin_at = len(before) - t
                    which.append(np.full(len(t), i))
                    ts.append(t)
                    hashes.append(span_hash(p, begin_at, begin_at + s))
                    more.append(span_hash(back, len(data) - begin_at - s, len(data) - begin_at))
                at = pa.array(np.concatenate(which))
                yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(ts).astype(np.int32)), signed(np.concatenate(hashes)), signed(np.concatenate(more))], names=["core", "around", "t", "h", "g"])

    each = rows.select("core", "around", "before", "after").mapInArrow(windows, "core bigint, around bigint, t int, h bigint, g bigint")
    twice = each.groupBy("core", "t", "h", "g").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    hit = each.join(twice, ["core", "t", "h", "g"]).groupBy("core", "around").agg(F.collect_set("t").alias("ts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for ts in batch.column(2).to_pylist():
                mask = np.zeros(s, bool)
                mask[ts] = True
                masks.append(np.packbits(mask).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], names=["core", "around", "mask"])

    return hit.mapInArrow(pack, "core bigint, around bigint, mask binary")


def removed_spans(texts: DataFrame, shape: Shape) -> DataFrame:
    """(key, n_removed, spans, kept_sha256) from texts (key, raw) with the list of their cores that hold repeated windows."""
    s, length = shape.s, shape.length

    def one(raw: bytes, rows: list[dict]) -> tuple:
        data = np.frombuffer(raw, np.uint8)
        c, _, around = shape.cores(data)
        start = np.zeros(len(data) + 1, np.int64)
        order = np.argsort(around, kind="stable")
        sorted_around = around[order]
        for r in rows:
            key = np.int64(r["around"]).view(np.uint64)
            for i in order[np.searchsorted(sorted_around, key) : np.searchsorted(sorted_around, key, side="right")]:
                at = c[i]
                low, high = max(0, s - 1 - (len(data) - at - shape.core)), min(s - 1, at)
                if r["mask"] is None:
                    t = np.arange(low, high + 1)
                else:
                    t = np.flatnonzero(np.unpackbits(np.frombuffer(r["mask"], np.uint8))[:s])
                start[at - t] = 1
        seen = np.cumsum(start[:-1])
        gone = seen - np.concatenate([np.zeros(min(length, len(data)), np.int64), seen[: max(len(data) - length, 0)]]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [one(raw.as_py() or b"", found.as_py()) for raw, found in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows])], names=["key", "n_removed", "spans", "kept_sha256"])

    return texts.select("key", "raw", "list").mapInArrow(run, "key binary, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of the keys; keys beyond a size are not broadcast, and the join that follows sorts out the rest."""
    return df.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= BROADCAST_KEYS else df


def repeated_strings(documents: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot_contexts: int = HOT_CONTEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which starts anywhere else, too.

    One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (in
    bytes, of the input). Texts are UTF-8; a null text is empty. Strings are judged on the
    input, so all of their places lose them, the first, too; texts shorter than ``length``
    lose nothing. Equal texts of that length lose all their bytes. Repeated rows are copies,
    ids are not looked at. An empty table gives an empty result; other columns are not read.

    Cores (see Shape) are counted over all documents. A core that always has the same context
    and is there twice makes all its windows repeated, which its hash tells without a suffix
    array; else the windows over its different contexts are compared by the common prefixes
    of neighbours in suffix arrays. Cores with more than ``hot_contexts`` contexts would fill
    one task: the hashes of their windows are counted instead, with the same result.
    """
    bounded_batches(documents.sparkSession)
    shape = Shape(length)
    raw = F.col(text_col).cast("binary")
    plain = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.coalesce(raw, F.lit("").cast("binary")).alias("raw"))
    per_text = written(plain.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max(F.octet_length("raw")).alias("size")), "copies")
    rows = written(core_rows(plain.filter(F.octet_length("raw") >= length), shape), "cores")
    cores = rows.groupBy("core").agg(F.sum("n").alias("total"), F.min("around").alias("least"), F.max("around").alias("most")).filter("total > 1")
    cores = cores.select("core", (F.col("least") != F.col("most")).alias("several"))
    found = written(rows.join(cores, "core"), "repeated-cores")
    # the contexts of a core that has several, with one place of each
    each = written(found.filter("several").groupBy("core", "around").agg(F.sum("n").alias("n"), F.min(F.struct("key", "at")).alias("x")).select("core", "around", "n", "x.key", "x.at"), "contexts")
    hot = each.groupBy("core").agg(F.count("*").alias("k")).filter(F.col("k") > hot_contexts).select("core")
    asked = each.groupBy("key").agg(F.collect_list(F.struct("core", "around", "at")).alias("list"))
    asked = asked.join(per_text.select("key", "rep"), "key")
    reps = plain.select("key", "doc_id", "raw")
    wanted = only(reps, each.select("key").distinct()).join(asked.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = contexts(wanted, shape)
    if hot.limit(1).count():
        texts = written(texts.dropDuplicates(["core", "around"]), "context-texts")
        cold, warm = texts.join(hot, "core", "left_anti"), texts.join(hot, "core", "left_semi")
        masks = compared(cold.repartition("core").sortWithinPartitions("core", "around"), shape, block_bytes).unionByName(compared_by_window(warm, shape))
    else:
        masks = compared(texts.repartition("core").sortWithinPartitions("core", "around"), shape, block_bytes)
    masks = masks.groupBy("core", "around").agg(F.first("mask").alias("mask"))
    masks = each.filter("n > 1").select("core", "around", F.lit(None).cast("binary").alias("mask")).unionByName(masks.join(each.filter("n > 1"), ["core", "around"], "left_anti"))
    # texts that are there once, with their cores that hold repeated windows
    single = found.join(per_text.filter("copies = 1").select("key"), "key")
    hits = single.filter("not several").select("key", "around", F.lit(None).cast("binary").alias("mask")).unionByName(single.filter("several").join(masks, ["core", "around"]).select("key", "around", "mask"))
    hits = written(hits.groupBy("key").agg(F.collect_list(F.struct("around", "mask")).alias("list")), "hits")
    done = written(removed_spans(only(plain.select("key", "raw"), hits.select("key")).join(hits, "key"), shape), "removed")
    lost = per_text.join(done, "key", "left").select("key", F.when((F.col("copies") > 1) & (F.col("size") >= length), F.col("size").cast("bigint")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), "copies", "spans", "kept_sha256")
    own = plain.select("doc_id", "key", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("own_sha256"))
    all_gone = (F.col("copies") > 1) & (F.col("n_removed") > 0)
    spans = F.when(all_gone, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")))
    return own.join(lost, "key").withColumn("spans", spans).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"), "spans")
