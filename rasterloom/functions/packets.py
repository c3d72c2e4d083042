"""Lengths in packet headers and other small integer rules of the encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import big, ceil_div, ceil_shift
from .geometry import max_levels

# fixed values: least length of a cleanup segment, and the first ones too long for both kinds
CLEANUP_LEAST, CLEANUP_END, REFINEMENT_END = 2, 65535, 2047
# fixed values: shorter sides stay undecomposed in lossless coding; sides and area of code-blocks, as exponents
LEAST_SIDE, SIDE_EXPONENTS, AREA_EXPONENT = 64, (2, 10), 12


def floor_log2(n: Column) -> Column:
    """For n >= 1, without floating point."""
    return F.length(F.bin(n.cast("bigint"))) - 1


def length_bits(lblock: Column, passes: Column) -> Column:
    return lblock + F.when(passes > 1, floor_log2(passes)).otherwise(0)


def cleanup_length_bits(lblock: Column, passes: Column) -> Column:
    """Placeholder passes come in threes and count, too."""
    groups = F.call_function("div", F.greatest(passes - 1, F.lit(0)).cast("bigint"), big(3))
    return lblock + floor_log2(groups * 3 + 1)


def fits_bits(value: Column, bits: Column) -> Column:
    return (bits >= 32) | (value < F.call_function("shiftleft", big(1), F.least(bits, F.lit(32)).cast("int")))


def segment_error(passes: Column, size: Column, cleanup: Column, refinement: Column) -> Column:
    """Null where the lengths of a high-throughput block's two segments agree with its bytes; else what is wrong first."""
    whole = F.when(cleanup == 0, size).otherwise(cleanup)
    late = (cleanup == 0) & (refinement != 0)
    return (F.when(passes == 0, F.when((size != 0) | (cleanup != 0) | (refinement != 0), "empty_has_segments"))
            .when(late, F.when(refinement != size, "refinement_only_mismatch").when(refinement >= REFINEMENT_END, "refinement_out_of_range"))
            .when(passes == 1, F.when(refinement != 0, "single_pass_has_refinement").when(whole != size, "single_pass_mismatch"))
            .when((cleanup == 0) | (refinement == 0), "segments_required").when(cleanup + refinement != size, "multi_pass_mismatch")
            .when(~cleanup.between(CLEANUP_LEAST, CLEANUP_END - 1), "cleanup_out_of_range").when(refinement >= REFINEMENT_END, "refinement_out_of_range"))


def lossless_levels(width: Column, height: Column, by_position: Column, asked: Column) -> Column:
    """Decomposition levels of lossless coding: as asked (null: not), capped by the size; else one, or by position until a side is at most 64."""
    side, most = F.least(width, height), max_levels(width, height)
    halvings = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0), lambda n, k: n + (ceil_shift(side.cast("bigint"), k) > LEAST_SIDE).cast("int"))
    return (F.when(asked.isNotNull(), F.when(side < LEAST_SIDE, 0).otherwise(F.least(asked, most)))
            .when(by_position, F.least(halvings, most)).otherwise((side >= LEAST_SIDE).cast("int")))


def block_error(width_exponent: Column, height_exponent: Column) -> Column:
    """Null where the sides 2**exponent and the area of a code-block are allowed."""
    low, high = SIDE_EXPONENTS
    return F.when((width_exponent > high) | (height_exponent > high), "side_too_large").when((width_exponent < low) | (height_exponent < low), "side_too_small").when(width_exponent + height_exponent > AREA_EXPONENT, "area_too_large")


def byte_target(width: Column, height: Column, bits_per_pixel: Column) -> Column:
    """Bytes at a rate, rounded up; null unless positive and finite."""
    size = F.ceil(width.cast("double") * height.cast("double") * bits_per_pixel / 8.0)
    return F.when(size > 0, size.cast("bigint"))


def byte_tolerance(target: Column) -> Column:
    return F.greatest(ceil_div(target.cast("bigint"), 100), big(512))


def scale_denominator(scale: Column) -> Column:
    """Null for an unknown scale."""
    return F.when(scale == "none", 1).when(scale == "half", 2).when(scale == "quarter", 4).when(scale == "eighth", 8)


def scaled_block_size(scale: Column) -> Column:
    """The side of a decoded DCT block."""
    return F.call_function("div", big(8), big(scale_denominator(scale)))


def worker_count(batch: Column, asked: Column, available: Column) -> Column:
    """One for a batch of at most one; else the asked or available workers, no more than the batch needs."""
    return F.when(batch <= 1, 1).otherwise(F.least(F.greatest(F.coalesce(asked, available), F.lit(1)), batch))


def roi_bitplanes(bitplanes: Column, shift: Column, most: Column) -> Column:
    """Null where the shifted bitplanes pass the limit."""
    return F.when(bitplanes + shift <= F.least(most, F.lit(255)), bitplanes + shift)


def roi_unshift(value: Column, shift: Column) -> Column:
    """Magnitudes of 2**shift or more belong to the region and go down; shifts of 63 or more leave all as they are."""
    bits = F.least(shift, F.lit(62)).cast("int")
    down = F.call_function("shiftright", F.abs(value), bits)
    return F.when((shift > 0) & (shift < 63) & (down > 0), F.signum(value).cast("bigint") * down).otherwise(value)


def bits_per_pixel(size: Column, width: Column, height: Column) -> Column:
    """Null for an empty image."""
    return F.when((width > 0) & (height > 0), size * 8.0 / (width.cast("double") * height))


def samples_per_image(width: Column, height: Column, channels: Column) -> Column:
    """Null where the product leaves 64 bits."""
    return F.try_multiply(F.try_multiply(big(width), big(height)), big(channels))


def step_entry(style: Column, steps: Column, band: Column, resolution: Column, levels: Column) -> Column:
    """(exponent, mantissa, error) of a band, from an array of steps (exponent, mantissa).

    Styles ``none`` and ``expounded`` have an entry for each band, LL at resolution 0 only;
    ``derived`` counts the exponent from the first entry's by the band's level.
    """
    place = F.when(resolution == 0, 0).when(band == "LL", -1).otherwise(1 + (resolution - 1) * 3 + F.when(band == "HL", 0).when(band == "LH", 1).otherwise(2))
    derived = style == "derived"
    entry = F.get(steps, F.when(derived, 0).otherwise(place).cast("int"))
    from_first = entry["exponent"] - levels + F.when(resolution == 0, levels).otherwise(levels + 1 - resolution)
    error = F.when(entry.isNull(), "missing_step").when(derived & (entry["exponent"] < levels), "invalid_exponents")
    exponent = F.when(error.isNull(), F.when(derived, from_first).otherwise(entry["exponent"]))
    return F.struct(exponent.alias("exponent"), F.when(error.isNull(), entry["mantissa"]).alias("mantissa"), error.alias("error"))
