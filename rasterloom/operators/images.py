"""Whole-image operators on rows of bytes: decode, encode, recode and wrap, each with an error column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import jpeg, jpeg2000
from ..sources import containers

PLANES = "component int, width bigint, height bigint, bits int, signed boolean, samples array<bigint>, error string"


def _planes(df: DataFrame, kernel: Callable[[bytes, dict], list[tuple]], key: str, content: str, extra: list[str]) -> DataFrame:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.string()]
    names = [f.split(" ")[0] for f in PLANES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [dict(zip(extra, v, strict=True)) for v in zip(*(batch.column(2 + i).to_pylist() for i in range(len(extra))), strict=True)] or [{}] * batch.num_rows
            for i, (data, options) in enumerate(zip(batch.column(1).to_pylist(), more, strict=True)):
                try:
                    rows = [(c, p.shape[1], p.shape[0], bits, signed, p.ravel(), None) for c, (p, bits, signed) in enumerate(kernel(data or b"", options))]
                except ValueError as e:
                    rows = [(None, None, None, None, None, None, str(e) or type(e).__name__)]
                yield pa.record_batch([batch.column(0).take(pa.array([i] * len(rows))), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], names=[key, *names])

    return df.select(key, F.col(content).cast("binary"), *extra).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {PLANES}")


def decode_images(df: DataFrame, key: str = "path", content: str = "content", region: str | None = None, reduce: str | None = None) -> DataFrame:
    """A row for each component plane of JPEG 2000 and JPEG files; an error row for a file that can't be decoded.

    region names a struct column (x, y, w, h), reduce an int column; nulls ask for all.
    """
    def kernel(data: bytes, o: dict) -> list[tuple]:
        part, k = o.get(region) if region else None, (o.get(reduce) if reduce else None) or 0
        area = tuple(part[n] for n in ("x", "y", "w", "h")) if part else None
        if data[:3] == containers.JPEG:
            if not 0 <= k <= 3:
                raise containers.Malformed("JPEG has three reduced sizes")
            planes = jpeg.decode(data, 8 >> k)
            if area:
                x, y, w, h = area
                full_h, full_w = (containers.jpeg_header(data)["sof"][n] for n in ("height", "width"))
                if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > full_w or y + h > full_h:
                    raise containers.Malformed("region is empty or leaves the image")
                planes = [p[y >> k : -(-(y + h) >> k), x >> k : -(-(x + w) >> k)] for p in planes]
            return [(p, 8, False) for p in planes]
        got = jpeg2000.decode(data, k, area)
        return [(p, c["bits"], c["signed"]) for p, c in zip(got["planes"], got["components"], strict=True)]

    return _planes(df, kernel, key, content, [c for c in (region, reduce) if c])


def _bytes(df: DataFrame, kernel: Callable[[tuple], bytes], columns: list[str], key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(1 + i).to_pylist() for i in range(len(columns))), strict=True):
                try:
                    out.append((kernel(row), None))
                except (ValueError, TypeError, IndexError) as e:
                    out.append((None, str(e) or type(e).__name__))
            yield pa.record_batch([batch.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=[key, "content", "error"])

    return df.select(key, *columns).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary, error string")


def encode_images(df: DataFrame, key: str = "image", kind: str = "j2k", **options) -> DataFrame:
    """Bytes of images (key, width, height, planes array<array<bigint>>): j2k, jp2 or jpeg."""
    def kernel(row: tuple) -> bytes:
        width, height, planes = row
        arrays = [np.array(p, np.int64).reshape(height, width) for p in planes]
        if kind == "jpeg":
            return jpeg.encode(arrays, **options)
        data = jpeg2000.encode(arrays, **options)
        return containers.wrap(data) if kind == "jp2" else data

    return _bytes(df, kernel, ["width", "height", "planes"], key)


def wrap_images(df: DataFrame, key: str = "path", kind: str = "jp2") -> DataFrame:
    return _bytes(df, lambda row: containers.wrap(bytes(row[0] or b""), kind), ["content"], key)


def jpeg_to_jpeg2000(df: DataFrame, key: str = "path", **options) -> DataFrame:
    """The pixels of JPEG files as lossless JPEG 2000; a file that fails is an error row."""
    return _bytes(df, lambda row: jpeg2000.encode(jpeg.decode(bytes(row[0] or b"")), **options), ["content"], key)


def dct_blocks(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, comp, by, bx, coeff, error): the quantized 8x8 blocks of JPEG files, by rows."""
    def kernel(data: bytes) -> Iterator[tuple]:
        for c, part in enumerate(jpeg.coefficients(data)["components"]):
            for y in range(part["down"]):
                for x in range(part["across"]):
                    yield c, y, x, part["blocks"][y, x].astype(">i2").tobytes()

    rows = containers.rows_of(df, kernel, "comp int, by bigint, bx bigint, packed binary", content=content, key=key)
    h = F.hex("packed")
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return rows.withColumn("coeff", F.when(F.col("packed").isNotNull(), F.transform(values, lambda v: F.when(v > 32767, v - 65536).otherwise(v)))).drop("packed")
