"""Quality layers by slope, and searches for a size or a quality."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codec import jpeg2000
from .batches import folded, layer_budget

MOST_SCALE = 1 << 20


def slope(distortion: Column, rate: Column) -> Column:
    """Distortion taken away by a byte; a segment without bytes comes first."""
    return F.when(rate == 0, F.lit(float("inf"))).otherwise(distortion / rate)


class Budgets:
    """Bytes used up to each layer; the last takes whatever is left."""

    def __init__(self, targets: list[int]) -> None:
        self.most, self.used = [layer_budget(x) for x in targets], [0] * len(targets)

    def place(self, least: int, size: int) -> int:
        last = len(self.most) - 1
        layer = next((i for i in range(least, last) if all(u + size <= m for u, m in zip(self.used[i:], self.most[i:], strict=True))), last)
        for i in range(layer, last + 1):
            self.used[i] += size
        return layer


def layers_by_slope(segments: DataFrame, targets: list[int], keys: list[str]) -> DataFrame:
    """(keys, block, segment, layer): always the steepest among the blocks' next segments is placed, so a good late segment waits for those before it.

    A segment's turn comes with the flattest of its block so far, so sorting by that gives the
    order of a merge of all blocks' queues. Placing is serial, within each tile (keys); its segments are
    streamed, and a layer is held for each of its blocks. A segment of unknown rate goes to the
    last layer and counts no bytes.
    """
    flattest = F.min(slope(F.col("distortion"), F.col("rate"))).over(Window.partitionBy(*keys, "block").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))

    def start() -> list:
        return [Budgets(targets), {}]

    def step(state: list, row: tuple) -> Iterator[tuple]:
        budgets, least = state
        _, block, segment, size = row
        layer = len(targets) - 1 if size is None else budgets.place(least.get(block, 0), size)
        if layer:
            least[block] = layer
        yield block, segment, layer

    def finish(state: list) -> Iterator[tuple]:
        return iter(())

    out = folded(segments.withColumn("turn", -flattest), keys, ["turn", "block", "segment", "rate"], start, step, finish, ["block", "segment", "layer"], ("block", "segment"))
    return out.withColumn("layer", F.col("layer").cast("int"))


class Unreachable(ValueError):
    pass


def to_size(make: Callable[[float], bytes], target: int, rounds: int = 8) -> tuple[bytes, float]:
    """The output nearest to ``target`` bytes that passes it by a hundredth (512 bytes at least) at most; ``make`` takes a step scale from 1."""
    most = target + max(512, -(-target // 100))
    low = high = 1.0
    tried = {high: len(make(high))}
    while tried[high] > most:
        if high >= MOST_SCALE:
            raise Unreachable(f"{min(tried.values())} bytes is the least")
        low, high = high, high * 2
        tried[high] = len(make(high))
    for _ in range(rounds):
        middle = (low + high) / 2
        tried[middle] = len(make(middle))
        low, high = (middle, high) if tried[middle] > target else (low, middle)
    best = min((s for s, n in tried.items() if n <= most), key=lambda s: (abs(tried[s] - target), s))
    return make(best), best


def to_psnr(make: Callable[[float], bytes], measure: Callable[[bytes], float], target: float, tolerance: float = 0.1, rounds: int = 8) -> tuple[bytes, float]:
    """The coarsest output found whose quality is ``target`` dB, less the tolerance, or more."""
    def good(scale: float) -> bool:
        return measure(make(scale)) + tolerance >= target

    if not good(1.0):
        raise Unreachable(f"{measure(make(1.0)):.3f} dB is the most")
    low = high = 1.0
    for _ in range(rounds):
        high *= 2
        if not good(high):
            break
        low = high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return make(low), low


def psnr(planes: list[np.ndarray], data: bytes, peak: float) -> float:
    got = jpeg2000.decode(data)["planes"]
    squares = sum(float(((a - b) ** 2).sum()) for a, b in zip(planes, got, strict=True))
    return math.inf if not squares else 10 * math.log10(peak * peak * sum(p.size for p in planes) / squares)


def encode_to_size(planes: list[np.ndarray], target: int, step: float = 1 / 1024, **options) -> bytes:
    return to_size(lambda s: jpeg2000.encode(planes, reversible=False, step=step * s, **options), target)[0]


def encode_to_psnr(planes: list[np.ndarray], target: float, bits: int = 8, step: float = 1 / 1024, **options) -> bytes:
    return to_psnr(lambda s: jpeg2000.encode(planes, bits=bits, reversible=False, step=step * s, **options), lambda d: psnr(planes, d, (1 << bits) - 1), target)[0]
