"""Media columns: ISO media containers, written from payloads and read without decoding."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

FRAME = 576  # a grey frame of 24 x 24 samples of 8 bits
WIDTH, HEIGHT, TIMESCALE, TICKS, KEY_EVERY, CHUNK_FRAMES = 24, 24, 600, 25, 12, 16
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container with one raw grey video track; the payload's frames are its samples."""
    n = len(payload) // FRAME
    duration, matrix = n * TICKS, struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = range(1, n + 1, KEY_EVERY)
    whole, rest = divmod(n, CHUNK_FRAMES)
    runs = ([(1, CHUNK_FRAMES)] if whole else []) + ([(whole + 1, rest)] if rest else [])
    chunks = whole + bool(rest)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), entry), full(b"stts", 0, 0, struct.pack(">III", 1, n, TICKS)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)), full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, k, 1) for a, k in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)), full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)))
        minf = box(b"minf", full(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x55C4, 0)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), minf)
        tkhd = full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full(b"mvhd", 0, 0, struct.pack(">IIIIiH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 65536, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    start = len(head) + len(moov(0)) + 8
    return head + moov(start) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, type, begin and end of the body) of each box, parents first; raises ValueError on a box that leaves its parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("truncated box size")
            (size,), body = struct.unpack_from(">Q", data, start + 8), start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        body += 16 if kind == b"uuid" else 0
        yield depth, kind, body, stop
        if kind in CONTAINERS:
            if depth > 16:
                raise ValueError("boxes are nested too deeply")
            yield from walk(data, body, stop, depth + 1)
        start = stop
    if start != end:
        raise ValueError("bytes after the last box")


def _numbers(data: bytes, at: int, end: int, n: int, code: str) -> tuple[int, ...]:
    if at + n * struct.calcsize(">" + code) > end:
        raise ValueError("a table leaves its box")
    return struct.unpack_from(f">{n}{code}", data, at)


def tracks(data: bytes) -> list[dict]:
    """Each track's handler, codec, timing and samples (offset, size, ticks, key), from its tables alone."""
    found: list[dict] = []
    for _, kind, at, end in walk(data):
        if kind == b"trak":
            found.append({"handler": "", "codec": "", "timescale": 0, "duration": 0, "stts": [], "stsc": [], "sizes": (), "chunks": (), "keys": None})
        if not found:
            continue
        t = found[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"hdlr":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            (n,) = _numbers(data, at + 4, end, 1, "I")
            wide = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            flat = _numbers(data, at + 8, end, n * wide, "Q" if kind == b"co64" else "I")
            name = {b"stts": "stts", b"stsc": "stsc", b"stss": "keys"}.get(kind, "chunks")
            t[name] = [flat[i : i + wide] for i in range(0, len(flat), wide)] if wide > 1 else flat
        elif kind == b"stsz":
            size, n = _numbers(data, at + 4, end, 2, "I")
            if size and n > len(data):
                raise ValueError("more samples than bytes")
            t["sizes"] = (size,) * n if size else _numbers(data, at + 12, end, n, "I")
        elif kind == b"stz2":
            bits, n = data[at + 7], _numbers(data, at + 8, end, 1, "I")[0]
            if bits == 4:
                packed = _numbers(data, at + 12, end, (n + 1) // 2, "B")
                t["sizes"] = tuple(v for b in packed for v in (b >> 4, b & 15))[:n]
            else:
                t["sizes"] = _numbers(data, at + 12, end, n, "B" if bits == 8 else "H")
    for t in found:
        t["samples"] = _samples(t, len(data))
    return found


def _samples(t: dict, length: int) -> list[tuple[int, int, int, bool]]:
    ticks = [d for n, d in t["stts"] for _ in range(min(n, len(t["sizes"])))]
    keys = None if t["keys"] is None else set(t["keys"])
    out, sample, run = [], 0, 0
    for chunk, offset in enumerate(t["chunks"], 1):
        while run + 1 < len(t["stsc"]) and t["stsc"][run + 1][0] <= chunk:
            run += 1
        for _ in range(t["stsc"][run][1] if t["stsc"] else 0):
            if sample >= len(t["sizes"]):
                break
            size = t["sizes"][sample]
            if offset + size > length:
                raise ValueError("a sample leaves the file")
            out.append((offset, size, ticks[sample] if sample < len(ticks) else 0, keys is None or sample + 1 in keys))
            offset, sample = offset + size, sample + 1
    if sample != len(t["sizes"]):
        raise ValueError("samples without a chunk")
    return out


def payload_of(data: bytes, samples: list[tuple[int, int, int, bool]]) -> bytes:
    """The samples' bytes in order; neighbouring ranges are read together."""
    parts, start, end = [], 0, 0
    for offset, size, _, _ in samples:
        if offset != end:
            parts.append(data[start:end])
            start = offset
        end = offset + size
    return b"".join([*parts, data[start:end]])


def filled(text: bytes) -> bytes:
    """A text with bytes 255 up to whole frames, one at least."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def store_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a container.

    A null text is empty. Bytes 255 fill the last frame, and an empty text has one such
    frame. Texts are stored one at a time, so the longest bounds a worker's memory; repeated
    rows are stored as often, an empty table gives an empty one, and columns other than the
    two are not read.
    """
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(filled(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return _texts(documents, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, timescale bigint, duration bigint, samples bigint, keyframes array<struct<offset:bigint,length:bigint>>, error string"
SCHEMA = f"doc_id bigint, n_bytes bigint, {FEATURES}"
_kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])), pa.string()]
_names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "samples", "keyframes", "error"]


def features(data: bytes) -> tuple:
    """What ``FEATURES`` names, of one container's first track."""
    sha = hashlib.sha256(data).hexdigest()
    try:
        t = tracks(data)[0]
        payload = payload_of(data, t["samples"])
    except (ValueError, IndexError, struct.error) as e:
        return (None, None, None, len(data), sha, None, None, None, None, None, None, str(e) or type(e).__name__)
    keys = [(o, s) for o, s, _, k in t["samples"] if k]
    ranges = hashlib.md5(repr(keys).encode()).hexdigest()[:12]
    feature = f"{t['handler']}/{t['codec']};{t['duration']}/{t['timescale']};samples={len(t['samples'])};keys={len(keys)};ranges={ranges}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), sha, feature, t["codec"], t["timescale"], t["duration"], len(t["samples"]), [{"offset": o, "length": s} for o, s in keys], None)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, of 64 rows or of as many as hold 256 KB in the column."""
    size = batch.column(column).nbytes // max(batch.num_rows, 1)
    step = max(1, min(64, (256 << 10) // max(size, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def read_media(stored: DataFrame) -> DataFrame:
    """Walks (doc_id, n_bytes, media) containers and reads their first track.

    A container that can't be read gives a row with its error and null values; null media
    count as empty bytes. ``feature`` sums up codec, timing and keyframe ranges; the ranges
    themselves are in ``keyframes``. Repeated rows give repeated rows, an empty table gives
    an empty one, and other columns are not read.
    """
    bounded_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = [features(x or b"") for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(_kinds))], names=["doc_id", "n_bytes", *_names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def text_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``read_media(store_texts(...))`` in one pass: a worker stores each text as a container and reads that again, so containers don't travel between workers."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, rows = [], []
                for x in part.column(1):
                    text = x.as_py() or b""
                    sizes.append(len(text))
                    rows.append(features(mux(filled(text))))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(_kinds))], names=["doc_id", "n_bytes", *_names])

    return _texts(documents, id_col, text_col).mapInArrow(run, SCHEMA)
