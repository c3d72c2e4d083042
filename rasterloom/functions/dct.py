"""Zig-zag order, DCT basis and inverse DCT of 8x8 blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import clamp, shr

#: The zig-zag walk over an 8x8 block: diagonals in turn, up and down.
ZIGZAG = [8 * y + d - y for d in range(15) for y in sorted(range(max(0, d - 7), min(d, 7) + 1), reverse=d % 2 == 0)]


def unzigzag(block: Column) -> Column:
    """Coefficients in zig-zag order to rows of the block."""
    place = [0] * 64
    for k, at in enumerate(ZIGZAG):
        place[at] = k
    return F.array(*[F.get(block, F.lit(k)) for k in place])


def basis(frequency: int, place: int) -> float:
    """Orthonormal DCT-II basis of length 8."""
    return (math.sqrt(0.125) if frequency == 0 else 0.5) * math.cos(math.pi * (2 * place + 1) * frequency / 16)


def basis_table(spark: SparkSession, name: str = "basis") -> DataFrame:
    """64 rows (k, i, weight)."""
    return spark.createDataFrame([(k, i, basis(k, i)) for k in range(8) for i in range(8)], "k int, i int, weight double")


def idct8(block: Column) -> Column:
    """Samples (array of 64 doubles, by rows) of 64 coefficients by rows: down the columns, then along the rows."""
    from .columns import let

    def cell(values: list[Column], i: int) -> Column:
        return sum((v * F.lit(basis(k, i)) for k, v in enumerate(values[1:], 1)), values[0] * F.lit(basis(0, i)))

    def rows(b: Column) -> Column:
        return F.array(*[cell([F.get(b, F.lit(8 * k + x)) for k in range(8)], y) for y in range(8) for x in range(8)])

    def along(b: Column) -> Column:
        return F.array(*[cell([F.get(b, F.lit(8 * y + k)) for k in range(8)], x) for y in range(8) for x in range(8)])

    return let(let(block, rows), along)


def dc_only_pixel(dc: Column) -> Column:
    """The pixel of a block whose only coefficient is DC."""
    return clamp(shr(dc + 4, 3) + 128, 0, 255)


def activity(block: Column) -> Column:
    """dc_only, bottom_half_zero or general, of 64 coefficients by rows."""
    rest = F.slice(block, 2, 63)
    return F.when(F.forall(rest, lambda v: v == 0), "dc_only").when(F.forall(F.slice(block, 33, 32), lambda v: v == 0), "bottom_half_zero").otherwise("general")
