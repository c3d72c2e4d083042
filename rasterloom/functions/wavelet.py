"""5/3 and 9/7 wavelet transforms of arrays, as nested higher-order functions (no exchange)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# fixed values: lifting steps and scale of the 9/7 filter
ALPHA, BETA, GAMMA, DELTA, KAPPA = -1.5861343, -0.052980117, 0.8829111, 0.44350687, 1.2301741


def _indices(n: Column, start: int = 0) -> Column:
    return F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))


def _evens(x: Column) -> Column:
    return F.filter(x, lambda v, i: i % 2 == 0)


def _odds(x: Column) -> Column:
    return F.filter(x, lambda v, i: i % 2 == 1)


def _lift(own: Column, other: Column, step, odd: bool) -> Column:
    """step(sample, left, right) for each sample of one parity; ends are mirrored."""
    last = F.size(other) - 1
    if odd:  # an odd sample has the even ones i and i + 1 beside it
        return F.transform(own, lambda v, i: step(v, F.get(other, i), F.get(other, F.least(i + 1, last))))
    return F.transform(own, lambda v, i: step(v, F.get(other, F.greatest(i - 1, F.lit(0))), F.get(other, F.least(i, last))))


def forward53(x: Column) -> Column:
    """Low then high part of array<bigint>; a single sample stays as it is."""
    def lifted(s: Column) -> Column:
        high = _lift(_odds(s), _evens(s), lambda v, a, b: v - F.shiftright(a + b, 1), True)
        return let(high, lambda h: F.concat(_lift(_evens(s), h, lambda v, a, b: v + F.shiftright(a + b + 2, 2), False), h))
    return let(x, lambda s: F.when(F.size(s) < 2, s).otherwise(lifted(s)))


def interleave(low: Column, high: Column) -> Column:
    n = F.size(low) + F.size(high)
    return F.transform(_indices(n), lambda i: F.when(i % 2 == 0, F.get(low, F.call_function("div", i, F.lit(2)).cast("int"))).otherwise(F.get(high, F.call_function("div", i, F.lit(2)).cast("int"))))


def _parts(x: Column) -> tuple[Column, Column]:
    half = F.shiftright(F.size(x) + 1, 1)
    return F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.greatest(F.size(x) - half, F.lit(0)))


def inverse53(x: Column) -> Column:
    def lifted(s: Column) -> Column:
        low, high = _parts(s)
        even = _lift(low, high, lambda v, a, b: v - F.shiftright(a + b + 2, 2), False)
        return let(even, lambda e: interleave(e, _lift(_parts(s)[1], e, lambda v, a, b: v + F.shiftright(a + b, 1), True)))
    return let(x, lambda s: F.when(F.size(s) < 2, s).otherwise(lifted(s)))


def forward97(x: Column) -> Column:
    """Low then high part of array<double>: four lifting steps, then the scale."""
    def step(c: float):
        return lambda v, a, b: v + F.lit(c) * (a + b)
    def lifted(s: Column) -> Column:
        return let(_lift(_odds(s), _evens(s), step(ALPHA), True), lambda h1: let(
            _lift(_evens(s), h1, step(BETA), False), lambda l1: let(
                _lift(h1, l1, step(GAMMA), True), lambda h2: let(
                    _lift(l1, h2, step(DELTA), False), lambda l2: F.concat(F.transform(l2, lambda v: v * F.lit(1.0 / KAPPA)), F.transform(h2, lambda v: v * F.lit(KAPPA)))))))
    return let(x, lambda s: F.when(F.size(s) < 2, s).otherwise(lifted(s)))


def inverse97(x: Column) -> Column:
    def step(c: float):
        return lambda v, a, b: v - F.lit(c) * (a + b)
    def lifted(s: Column) -> Column:
        low, high = _parts(s)
        return let(F.transform(low, lambda v: v * F.lit(KAPPA)), lambda l2: let(
            F.transform(high, lambda v: v * F.lit(1.0 / KAPPA)), lambda h2: let(
                _lift(l2, h2, step(DELTA), False), lambda l1: let(
                    _lift(h2, l1, step(GAMMA), True), lambda h1: let(
                        _lift(l1, h1, step(BETA), False), lambda e: interleave(e, _lift(h1, e, step(ALPHA), True)))))))
    return let(x, lambda s: F.when(F.size(s) < 2, s).otherwise(lifted(s)))


def transpose(m: Column) -> Column:
    return F.transform(F.get(m, F.lit(0)), lambda _, j: F.transform(m, lambda row: F.get(row, j)))


def forward_plane(m: Column, line=forward53) -> Column:
    """One level of array<array>: columns first, then rows."""
    return F.transform(let(F.transform(let(m, transpose), line), transpose), line)


def inverse_plane(m: Column, line=inverse53) -> Column:
    """Undoes forward_plane: rows first, then columns."""
    return let(F.transform(let(F.transform(m, line), transpose), line), transpose)


def forward_levels(m: Column, levels: int, line=forward53) -> Column:
    """Splits the low part of each level again, in place."""
    def corner(p: Column, k: int) -> tuple[Column, Column]:
        h, w = F.size(p), F.size(F.get(p, F.lit(0)))
        for _ in range(k):
            h, w = F.shiftright(h + 1, 1), F.shiftright(w + 1, 1)
        return h, w

    def again(k: int):
        def split(p: Column) -> Column:
            h, w = corner(p, k)
            part = forward_plane(F.transform(F.slice(p, F.lit(1), h), lambda row: F.slice(row, F.lit(1), w)), line)
            return let(part, lambda q: F.transform(p, lambda row, y: F.when(y < h, F.concat(F.get(q, y), F.slice(row, w + 1, F.size(row)))).otherwise(row)))

        return split

    out = forward_plane(m, line)
    for k in range(1, levels):
        out = let(out, again(k))
    return out


def linear53_taps(n: int) -> list[tuple[str, int, int, float]]:
    """(band, output, sample, weight) of the 5/3 analysis without rounding, mirrored ends folded in."""
    def fold(i: int) -> int:
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i

    rows: dict[tuple[str, int, int], float] = {}
    if n < 2:
        return [("low", i, i, 1.0) for i in range(n)]
    for i in range(n):
        band, centre = ("high", i) if i % 2 else ("low", i)
        weights = {-1: -0.5, 0: 1.0, 1: -0.5} if i % 2 else {-2: -0.125, -1: 0.25, 0: 0.75, 1: 0.25, 2: -0.125}
        for d, w in weights.items():
            key = (band, i // 2, fold(centre + d))
            rows[key] = rows.get(key, 0.0) + w
    return [(*k, w) for k, w in rows.items() if w]
