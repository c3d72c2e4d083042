"""Shared helpers: reading tables, written intermediate tables, word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker is handed at once, in bytes; texts come whole, however long one is.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session doesn't; by default they hold 10,000 rows, however long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns a worker's freed memory to the system, which else stays its own, through later stages, too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, which goes when the driver ends.

    Where that setting is unset, a temporary folder serves a local session; a cluster has no
    folder that all executors see, then, and a ValueError says so.
    """
    found = spark.conf.get("rasterloom.shared.dir", None)
    if not found:
        context = spark.sparkContext
        top = context.getConf().get("spark.checkpoint.dir")
        if not top and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = top or tempfile.mkdtemp(prefix="rasterloom-")
        found = f"{top.rstrip('/')}/rasterloom-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        spark.conf.set("rasterloom.shared.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def md5_bits(column) -> object:
    """The first 60 bits of a string's MD5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(column), 1, 15), 16, 10).cast("bigint")


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] hashes data[:i]; data are unsigned integers."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each span, whatever its place."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64) * MIX1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes above 32 (the words between ASCII white space)."""
    edge = np.diff(np.concatenate([[False], data > 32, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, start and end."""
    start, end = word_spans(data)
    return span_hash(prefix_hash(data), start, end), start, end


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(BASE) + words[i : i + n])
    return out


CHUNK_BITS = 22


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the least value of each window of w 64-bit values, ascending and without repeats; of all values where there are fewer than w.

    The upper 42 bits count, and the leftmost of equal ones, so equal windows give equal places in them.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= w:
        return np.array([int(np.argmin(values >> np.uint64(CHUNK_BITS)))], np.int64)
    out, step, mask = [], (1 << CHUNK_BITS) - 2 * w, np.uint64((1 << CHUNK_BITS) - 1)
    for at in range(0, n - w + 1, step):
        part = values[at : at + step + w - 1]
        m = len(part)
        rows = -(-m // w)
        held = np.full(rows * w, ~np.uint64(0))
        held[:m] = (part & ~mask) | np.arange(m, dtype=np.uint64)
        held = held.reshape(rows, w)
        ahead = np.minimum.accumulate(held, axis=1).ravel()
        behind = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        out.append((least & mask).astype(np.int64) + at)
    got = np.concatenate(out)
    return np.unique(got) if len(out) > 1 else got
