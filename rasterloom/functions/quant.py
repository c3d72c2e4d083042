"""Quantizer steps and dead-zone quantization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_delta(range_bits: Column, exponent: Column, mantissa: Column) -> Column:
    """2**(R - e) (1 + m / 2048)."""
    return F.pow(F.lit(2.0), (range_bits - exponent).cast("double")) * (1.0 + mantissa / 2048.0)


def step_from_delta(range_bits: Column, delta: Column) -> tuple[Column, Column]:
    """(exponent, mantissa): the mantissa is rounded, with a carry at 2048; exponents stay in 0..31."""
    e0 = range_bits - F.floor(F.log2(delta)).cast("int")
    m0 = F.round((delta / F.pow(F.lit(2.0), (range_bits - e0).cast("double")) - 1.0) * 2048.0).cast("int")
    carry = m0 >= 2048
    return F.greatest(F.least(F.when(carry, e0 - 1).otherwise(e0), F.lit(31)), F.lit(0)), F.when(carry, 0).otherwise(m0)


def dead_zone(value: Column, delta: Column) -> Column:
    """The magnitude is cut to a whole number of steps."""
    return (F.signum(value) * F.floor(F.abs(value) / delta)).cast("bigint")


def dequantize(index: Column, delta: Column, bias: float = 0.5) -> Column:
    return F.when(index == 0, 0.0).otherwise(F.signum(index.cast("double")) * (F.abs(index) + bias) * delta)


def band_gain(band: Column) -> Column:
    return F.when(band == "LL", 0).when(band == "HH", 2).otherwise(1)


def reversible_bitplanes(depth: Column, band: Column, guard) -> Column:
    return depth + band_gain(band) + guard - 1


def midpoint(magnitude: Column, bits_missing: Column) -> Column:
    """A magnitude whose low bits were not decoded goes to the middle of its interval."""
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(bits_missing - 1, F.lit(0)).cast("int"))
    return F.when((magnitude > 0) & (bits_missing > 0), magnitude + half).otherwise(magnitude)
