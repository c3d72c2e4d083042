"""Half-open rectangles, struct<x0,y0,x1,y1:bigint>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import big, ceil_div

NAMES = ("x0", "y0", "x1", "y1")


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*(big(v).alias(n) for v, n in zip((x0, y0, x1, y1), NAMES, strict=True)))


def full(width, height) -> Column:
    return rect(0, 0, width, height)


def empty(r: Column) -> Column:
    return (r.x0 >= r.x1) | (r.y0 >= r.y1)


def intersects(a: Column, b: Column) -> Column:
    """Whether the two overlap; rectangles that only touch don't."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def intersect(a: Column, b: Column) -> Column:
    """The common part: all zero if they are apart, of no area if they touch."""
    x0, y0, x1, y1 = F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)
    apart = (x0 > x1) | (y0 > y1)
    return F.when(apart, rect(0, 0, 0, 0)).otherwise(rect(x0, y0, x1, y1))


def union(a: Column, b: Column) -> Column:
    """The bounding box; an empty rectangle adds nothing."""
    both = rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))
    return F.when(empty(a), b).when(empty(b), a).otherwise(both)


def expanded_within(r: Column, margin, bounds: Column) -> Column:
    return rect(F.greatest(r.x0 - margin, bounds.x0), F.greatest(r.y0 - margin, bounds.y0), F.least(r.x1 + margin, bounds.x1), F.least(r.y1 + margin, bounds.y1))


def within(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height)


def scaled_covering(r: Column, denominator) -> Column:
    """At 1/denominator: starts go down, ends go up."""
    d = big(denominator)
    return rect(F.call_function("div", r.x0, d), F.call_function("div", r.y0, d), ceil_div(r.x1, d), ceil_div(r.y1, d))
