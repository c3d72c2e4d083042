"""Homogeneous groups, bounded chunks, quality layers, and decisions on whole inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def homogeneous_groups(images: DataFrame, keys: list[str], index: str = "source_index") -> DataFrame:
    """A row for each group of equal keys, in the order of first occurrence; members are counted and summed up, not collected.

    Numbering the groups takes one task, which gets a row for each different key, after the
    partial counts.
    """
    grouped = images.groupBy(*keys).agg(F.min(index).alias("first_index"), F.count("*").alias("members"), F.max(index).alias("last_index"))
    return grouped.withColumn("group_no", F.row_number().over(Window.orderBy("first_index")) - 1)


def member_places(images: DataFrame, keys: list[str], index: str = "source_index") -> DataFrame:
    """Each image's place in its group, in input order."""
    return images.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1)


def pass_bucket(passes: Column) -> Column:
    return F.when(passes == 1, "cleanup").when(passes == 2, "sigprop").when(passes >= 3, "magref")


def chunk_jobs(jobs: DataFrame, max_jobs: int, max_payload: int, max_descriptor: int, order: str, *keys: str) -> DataFrame:
    """Chunks of each bucket in input order, closed before a job that would pass a cap.

    A chunk depends on all before it, so a bucket of one key is a fold over its jobs in
    order. ``keys`` (a stream, a device) bound what one fold gets.
    """
    def start() -> list:
        return [0, None, None, 0, 0, 0]  # chunk number, first, last, jobs, payload, descriptor

    def step(c: list, job: tuple) -> Iterator[tuple]:
        place, payload, descriptor = job
        if c[3] and (c[3] == max_jobs or c[4] + payload > max_payload or c[5] + descriptor > max_descriptor):
            yield tuple(c)
            c[:] = [c[0] + 1, None, None, 0, 0, 0]
        c[:] = [c[0], place if not c[3] else c[1], place, c[3] + 1, c[4] + payload, c[5] + descriptor]

    def finish(c: list) -> Iterator[tuple]:
        yield tuple(c)

    return folded(jobs, [*keys, "bucket"], [order, "payload", "descriptor"], start, step, finish, ["chunk", "first", "last", "n", "payload", "descriptor"])


def folded(df: DataFrame, keys: list[str], columns: list[str], start: Callable[[], list], step: Callable[[list, tuple], Iterator[tuple]], finish: Callable[[list], Iterator[tuple]], names: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """The rows (bigints, after the keys; ``same`` ones as the columns are) that a serial fold over each group's rows, sorted by ``columns``, gives out; a group is streamed, not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, kinds = None, None, []
        for batch in batches:
            out = []
            kinds = [*batch.schema.types[: len(keys)], *(batch.schema.field(n).type if n in same else pa.int64() for n in names)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[: len(keys)]
                if state is None or key != last:
                    if state is not None:
                        out += [last + r for r in finish(state)]
                    last, state = key, start()
                out += [key + r for r in step(state, row[len(keys) :])]
            yield record(out, kinds)
        if state is not None:
            yield record([last + r for r in finish(state)], kinds)

    def record(rows: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[*keys, *names])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` {df.schema[n].dataType.simpleString() if n in same else 'bigint'}" for n in names)])
    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns).mapInArrow(run, schema)


def layer_budget(target: int) -> int:
    """A layer may pass its target by a hundredth, and by 512 bytes at least."""
    return target + max(512, target // 100)


def assign_layers(segments: DataFrame, targets: list[int], *keys: str) -> DataFrame:
    """A layer for each block of a tile (keys): segments in (block, segment) order go to the first layer, not below the block's, whose later budgets all hold them; then a block's segments share its last layer."""
    last, targets = len(targets) - 1, [layer_budget(x) for x in targets]

    def start() -> list:
        return [[0] * len(targets), None, 0, 0]  # bytes used by each layer, block, its layer, its segments

    def step(a: list, segment: tuple) -> Iterator[tuple]:
        used, held, least, n = a
        block, _, rate = segment
        if n and block != held:
            yield held, least, n
            n = 0
        layer, at_least = last, least if n else 0
        while layer > at_least and used[layer] + rate <= targets[layer] and used[layer - 1] + rate <= targets[layer - 1]:
            layer -= 1
        for i in range(layer, last + 1):
            used[i] += rate
        a[1:] = [block, layer, n + 1]

    def finish(a: list) -> Iterator[tuple]:
        yield a[1], a[2], a[3]

    out = folded(segments, list(keys), ["block", "segment", "rate"], start, step, finish, ["block", "layer", "segments"])
    return out.withColumn("layer", F.col("layer").cast("int"))


def monotonic_layers(df: DataFrame, layer: str = "layer") -> DataFrame:
    """The greatest layer so far within a block."""
    return df.withColumn("monotonic", F.max(layer).over(Window.partitionBy("block").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)))


def dc_prediction(diffs: DataFrame, interval: int) -> DataFrame:
    """Running sums of a component's differences, from 0 at each restart."""
    part = diffs.withColumn("restart", F.call_function("div", F.col("mcu"), F.lit(interval).cast("bigint")))
    return part.withColumn("dc", F.sum("diff").over(Window.partitionBy("comp", "restart").orderBy("mcu").rowsBetween(Window.unboundedPreceding, 0)))


LOSSLESS = ("jpeg2000_lossless", "htjpeg2000_lossless", "jpeg_lossless")


def passthrough_reason(source: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """The first requirement that is not met, in a fixed order; null if the bytes may be copied. Null optional requirements ask for nothing."""
    reason = F.when(source["size"] == 0, "empty_payload").when(source["syntax"] != wanted["syntax"], "transfer_syntax").when(source["kind"] != wanted["kind"], "payload_kind")
    for name in ("dimensions", "components", "bit_depth", "colorspace", "tile_layout"):
        if name in wanted:
            reason = reason.when(wanted[name].isNotNull() & ~source[name].eqNullSafe(wanted[name]), name)
    return reason


def recode_mode(syntax: Column, kind: Column, wanted_kind: Column, reversible_53: Column) -> Column:
    same = syntax == "htjpeg2000_lossless"
    return (F.when(same & (kind == wanted_kind), "passthrough").when(same & (kind == "codestream") & (wanted_kind == "jph"), "codestream_preserving")
            .when((syntax == "jpeg2000_lossless") & reversible_53, "coefficient").otherwise("pixel"))


def palette_lookup(df: DataFrame, entries: Column, index: Column) -> DataFrame:
    """value, or an error for an index outside the palette."""
    good = (index >= 0) & (index < F.size(entries))
    return df.withColumn("value", F.when(good, F.get(entries, index.cast("int")))).withColumn("error", F.when(~good | index.isNull(), "palette_index"))


def override(default: DataFrame, own: DataFrame, keys: list[str], values: list[str], flags: list[str]) -> DataFrame:
    """Component settings over defaults: own values win, flags add to the default's."""
    o = own.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*values, *flags)))
    j = default.join(o, keys, "left")
    return j.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in values), *(F.col(c).bitwiseOR(F.coalesce(f"_{c}", F.lit(0).cast("bigint"))).alias(c) for c in flags))
