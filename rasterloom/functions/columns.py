"""Small Column helpers for exact integer arithmetic on bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shr(x: Column, n: int) -> Column:
    """Floor of x / 2**n, for negative x, too."""
    return F.shiftright(x, n)


def ceil_div(a: Column, b) -> Column:
    """Ceiling of a / b for a >= 0 and b > 0."""
    return F.call_function("div", a + b - 1, big(b))


def ceil_shift(a: Column, k) -> Column:
    """Ceiling of a / 2**k for a >= 0; k may be a column."""
    return F.call_function("shiftright", a + F.call_function("shiftleft", big(1), k) - 1, k)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, big(high)), big(low))
