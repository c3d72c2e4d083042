"""Canonical Huffman codes and variable-length integers, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_codes(bits: Column) -> Column:
    """array<struct<length,code,idx>> from the counts of codes of 1, 2, .. bits.

    Codes of a length follow each other; the next length begins at twice the next code.
    Null if the counts don't fit into their lengths.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("idx"), F.lit(True).alias("ok"), F.expr("cast(array() as array<struct<length:int,code:bigint,idx:bigint>>)").alias("out"))
    indexed = F.transform(bits, lambda n, i: F.struct(n.cast("bigint").alias("n"), (i + 1).alias("length")))

    def step(s: Column, b: Column) -> Column:
        made = F.when(b.n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), b.n - 1), lambda j: F.struct(b.length.alias("length"), (s.next + j).alias("code"), (s.idx + j).alias("idx")))).otherwise(F.expr("cast(array() as array<struct<length:int,code:bigint,idx:bigint>>)"))
        full = s.next + b.n > F.call_function("shiftleft", F.lit(1).cast("bigint"), b.length)
        return F.struct(((s.next + b.n) * 2).alias("next"), (s.idx + b.n).alias("idx"), (s.ok & ~full).alias("ok"), F.concat(s.out, made).alias("out"))

    return F.aggregate(indexed, start, step, lambda s: F.when(s.ok, s.out))


def extend(value: Column, size: Column) -> Column:
    """Signed value of ``size`` magnitude bits."""
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(size - 1, F.lit(0)).cast("int"))
    return F.when(size == 0, F.lit(0).cast("bigint")).when(value < half, value - 2 * half + 1).otherwise(value)


def varints(octets: Column) -> Column:
    """Integers of 7-bit groups, high first; the high bit tells that more follow. Null if the last one doesn't end."""
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(False).alias("open"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(s: Column, b: Column) -> Column:
        v = F.shiftleft(s.v, 7) + b.bitwiseAND(127)
        more = b >= 128
        return F.struct(F.when(more, v).otherwise(F.lit(0).cast("bigint")).alias("v"), more.alias("open"), F.when(more, s.out).otherwise(F.concat(s.out, F.array(v))).alias("out"))

    return F.aggregate(octets, start, step, lambda s: F.when(~s.open, s.out))


def to_varint(value: Column) -> Column:
    """The 7-bit groups of a non-negative value."""
    groups = F.greatest(F.call_function("div", F.length(F.bin(value)) + 6, F.lit(7)), F.lit(1)).cast("int")
    return F.transform(F.sequence(groups - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", value, i * 7).bitwiseAND(127) + F.when(i > 0, 128).otherwise(0))


def octets(data: Column) -> Column:
    """A binary as array<bigint>."""
    h = F.hex(data)
    return F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(0), F.shiftright(F.length(h), 1) - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
