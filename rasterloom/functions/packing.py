"""Planes and interleaved pixels, as arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import big

OPAQUE = 255


def interleave(planes: Column) -> Column:
    """Samples pixel by pixel, of planes of equal length."""
    return F.flatten(F.transform(F.get(planes, F.lit(0)), lambda _, i: F.transform(planes, lambda p: F.get(p, i))))


def deinterleave(samples: Column, channels: int, depth: int, signed: bool = False) -> Column:
    """Planes of interleaved samples; unsigned ones are centred on 0. Null where the samples make no whole pixels."""
    shift = 0 if signed else 1 << (depth - 1)

    def plane(c: int) -> Column:
        return F.transform(F.filter(samples, lambda _, i: i % channels == c), lambda v: v - shift)

    planes = [plane(c) for c in range(channels)]
    return F.when(F.size(samples) % channels == 0, F.array(*planes))


def add_alpha(samples: Column) -> Column:
    """Three channels become four; the fourth is opaque."""
    first = F.filter(samples, lambda _, i: i % 3 == 0)
    return F.flatten(F.transform(first, lambda v, i: F.array(v, F.get(samples, i * 3 + 1), F.get(samples, i * 3 + 2), big(OPAQUE))))


def drop_alpha(samples: Column) -> Column:
    """Four channels become three."""
    return F.filter(samples, lambda _, i: i % 4 < 3)


def region(samples: Column, channels: int, width: int, x0: int, y0: int, x1: int, y1: int) -> Column:
    """The pixels of a rectangle (ends exclusive) of an interleaved image."""

    def inside(_: Column, i: Column) -> Column:
        pixel = F.floor(i / channels)
        x, y = pixel % width, F.floor(pixel / width)
        return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)

    return F.filter(samples, inside)


def strided(samples: Column, row: int, stride: int) -> Column:
    """Rows of ``row`` samples that begin ``stride`` samples apart, with zeros between; nothing follows the last row."""
    if stride < row:
        raise ValueError("a stride is at least a row's length")
    gap = F.array(*[big(0)] * (stride - row)) if stride > row else F.array().cast("array<bigint>")
    last = F.size(samples) - 1
    return F.flatten(F.transform(samples, lambda v, i: F.when((i % row == row - 1) & (i < last), F.concat(F.array(big(v)), gap)).otherwise(F.array(big(v)))))
