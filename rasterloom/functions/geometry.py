"""Tile, resolution, sub-band, precinct and code-block arithmetic of the JPEG 2000 reference grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import big, ceil_div, ceil_shift
from .rects import rect


def tile_rect(index: Column, grid_w: Column, grid_h: Column, tile_w: Column, tile_h: Column, off_x=0, off_y=0, tile_off_x=0, tile_off_y=0) -> Column:
    """The tile's rectangle, clipped to the image area (B-7 to B-10)."""
    across = ceil_div(grid_w - big(tile_off_x), tile_w)
    p, q = index % across, F.call_function("div", index, across)
    x0, y0 = big(tile_off_x) + p * tile_w, big(tile_off_y) + q * tile_h
    return rect(F.greatest(x0, big(off_x)), F.greatest(y0, big(off_y)), F.least(x0 + tile_w, grid_w), F.least(y0 + tile_h, grid_h))


def tile_count(grid_w: Column, grid_h: Column, tile_w: Column, tile_h: Column, tile_off_x=0, tile_off_y=0) -> Column:
    return ceil_div(grid_w - big(tile_off_x), tile_w) * ceil_div(grid_h - big(tile_off_y), tile_h)


def component_rect(tile: Column, xr, yr) -> Column:
    """B-12: on the component's own grid."""
    return rect(ceil_div(tile.x0, xr), ceil_div(tile.y0, yr), ceil_div(tile.x1, xr), ceil_div(tile.y1, yr))


def resolution_rect(component: Column, levels: Column, resolution: Column) -> Column:
    """B-14."""
    k = (levels - resolution).cast("int")
    return rect(*(ceil_shift(component[n], k) for n in ("x0", "y0", "x1", "y1")))


def decomposition_level(levels: Column, resolution: Column) -> Column:
    return F.when(resolution == 0, levels).otherwise(levels - resolution + 1)


def band_coordinate(value: Column, level: Column, high) -> Column:
    """B-15 for one coordinate; high: a boolean column."""
    half = F.call_function("shiftleft", big(1), F.greatest(level - 1, F.lit(0)).cast("int"))
    moved = F.when(high & (level > 0), F.greatest(value - half, big(0))).otherwise(value)
    return ceil_shift(moved, level.cast("int"))


def band_rect(component: Column, level: Column, band: Column) -> Column:
    """Band names: LL, HL (high across), LH (high down), HH."""
    hx, hy = band.isin("HL", "HH"), band.isin("LH", "HH")
    return rect(band_coordinate(component.x0, level, hx), band_coordinate(component.y0, level, hy), band_coordinate(component.x1, level, hx), band_coordinate(component.y1, level, hy))


def cells(low: Column, high: Column, exponent) -> Column:
    """B-16 for one axis: how many cells of 2**exponent meet [low, high); none if that is empty."""
    e = exponent.cast("int") if isinstance(exponent, Column) else F.lit(exponent)
    return F.when(high > low, ceil_shift(high, e) - F.call_function("shiftright", low, e)).otherwise(big(0))


def block_exponent(block: int, precinct: Column, resolution: Column) -> Column:
    """B-17 and B-18: a code-block is no larger than the precinct's part in a band."""
    return F.least(F.lit(block), F.when(resolution > 0, precinct - 1).otherwise(precinct)).cast("int")


def max_levels(width: Column, height: Column) -> Column:
    """floor(log2(shorter side)), without floating point."""
    side = F.least(width, height)
    return F.when(side > 0, F.length(F.bin(side)) - 1).otherwise(0)


def idwt_band_index(origin: Column, local: Column, low) -> Column:
    """The place in a band of a sample at ``local`` in a line that begins at ``origin``."""
    at = origin + local
    first = F.when(low, ceil_shift(origin, F.lit(1))).otherwise(F.shiftright(origin, 1))
    return F.when(low, ceil_shift(at, F.lit(1))).otherwise(F.shiftright(at, 1)) - first


def idwt_margin(reversible: Column) -> Column:
    # fixed values: samples that a synthesis of the 5/3 and of the 9/7 filter is widened by
    return F.when(reversible, 16).otherwise(40)


def level_size(size: Column, level: Column, low: bool) -> Column:
    """A side's low (ceil) or high (floor) length after ``level`` splits of its low part."""
    before = ceil_shift(size, (level - 1).cast("int"))
    return ceil_shift(before, F.lit(1)) if low else F.shiftright(before, 1)
