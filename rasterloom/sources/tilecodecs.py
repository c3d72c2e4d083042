"""Decompression of tile payloads, bounded by the expected size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TileError(ValueError):
    pass


def deflate(data: bytes, limit: int) -> bytes:
    """zlib, or raw deflate where that fails."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            out = d.decompress(data, limit + 1)
        except zlib.error:
            continue
        if len(out) > limit:
            raise TileError("output is larger than expected")
        if not d.eof:
            raise TileError("truncated input")
        return out
    raise TileError("malformed deflate")


def lzw(data: bytes, limit: int) -> bytes:
    """TIFF's LZW: high bit first, 9 to 12 bits, which grow one code early."""
    table: list[bytes] = []
    out, held, bits, width, last, at = bytearray(), 0, 0, 9, None, 0
    while True:
        while bits < width:
            if at >= len(data):
                raise TileError("truncated input")
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
        if code < len(table) and code != 256:
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise TileError("malformed lzw")
        out += entry
        if len(out) > limit:
            raise TileError("output is larger than expected")
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def lzw_encode(data: bytes) -> bytes:
    """The inverse of ``lzw``."""
    out, bits = 0, 0
    table = {bytes([i]): i for i in range(256)}
    size, width, word = 258, 9, b""

    def put(code: int) -> None:
        nonlocal out, bits
        out, bits = (out << width) | code, bits + width

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def zstd(data: bytes, limit: int) -> bytes:
    import zstandard

    try:
        out = zstandard.ZstdDecompressor().stream_reader(data).read(limit + 1)
    except zstandard.ZstdError as e:
        raise TileError("malformed zstd") from e
    if len(out) > limit:
        raise TileError("output is larger than expected")
    return out


def uncompressed(data: bytes, limit: int) -> bytes:
    if len(data) != limit:
        raise TileError("size differs from the expected one")
    return data


CODECS: dict[str, Callable[[bytes, int], bytes]] = {"deflate": deflate, "lzw": lzw, "zstd": zstd, "uncompressed": uncompressed}


def decompress(tiles: DataFrame, codec: str = "codec", payload: str = "payload", size: str = "size") -> DataFrame:
    """Adds ``data`` and ``error`` to rows with a codec, a payload and the expected size."""
    schema = tiles.schema
    names = schema.fieldNames()

    def one(kind: str | None, data: bytes | None, limit: int | None) -> tuple[bytes | None, str | None]:
        try:
            return CODECS[kind](data or b"", limit or 0), None
        except KeyError:
            return None, "unknown codec"
        except TileError as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(*x) for x in zip(*(batch.column(names.index(n)).to_pylist() for n in (codec, payload, size)), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=[*names, "data", "error"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return tiles.select(*(F.col(n) for n in names)).mapInArrow(run, f"{out}, data binary, error string")
