"""Operators without SQL, and cases that the derived tables don't hold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codec import jpeg2000
from rasterloom.functions import color, dct, geometry, huffman, rects, resample, wavelet
from rasterloom.operators import batches, metrics, rate
from rasterloom.plans import catalogue

from .test_jpeg2000 import image

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("n", range(1, 18))
def test_lines_of_every_length(spark, n):
    rng = random.Random(n)
    xs = [rng.randrange(-300, 300) for _ in range(n)]
    df = spark.createDataFrame([(xs, [float(x) for x in xs])], "s array<bigint>, d array<double>")
    row = df.select(wavelet.inverse53(wavelet.forward53(F.col("s"))).alias("a"), wavelet.inverse97(wavelet.forward97(F.col("d"))).alias("b"), wavelet.forward53(F.col("s")).alias("c")).first()
    assert row.a == xs and all(abs(p - q) < 1e-6 for p, q in zip(row.b, xs))
    low, high = jpeg2000.analyse(np.array(xs), 0, True)
    assert row.c == low.tolist() + high.tolist()
    linear = {}
    for band, out, at, w in wavelet.linear53_taps(n):
        linear[band, out] = linear.get((band, out), 0) + w * xs[at]
    assert all(abs(linear["low", i] - v) <= 1 for i, v in enumerate(low)) and all(abs(linear["high", i] - v) <= 1 for i, v in enumerate(high))


def test_rectangles(spark):
    r = lambda *v: rects.rect(*v)
    values = spark.range(1).select(rects.intersects(r(0, 0, 4, 4), r(4, 0, 8, 4)).alias("touch"), rects.empty(rects.intersect(r(0, 0, 4, 4), r(4, 0, 8, 4))).alias("none"), rects.intersect(r(0, 0, 2, 2), r(5, 5, 6, 6)).alias("apart"), rects.union(r(3, 3, 3, 9), r(1, 1, 2, 2)).alias("union"), rects.scaled_covering(r(3, 3, 9, 9), 4).alias("scaled")).first()
    assert not values.touch and values.none and tuple(values.apart) == (0, 0, 0, 0) and tuple(values.union) == (1, 1, 2, 2) and tuple(values.scaled) == (0, 0, 3, 3)


def test_band_index(spark):
    for origin in (0, 1, 5, 8):
        for low in (True, False):
            own = [i for i in range(9) if (origin + i) % 2 == (0 if low else 1)]
            got = [one(spark, geometry.idwt_band_index(F.col("o"), F.col("i"), F.lit(low)), o=origin, i=i) for i in own[:3]]
            assert got == list(range(len(own)))[:3]


def test_published_huffman_codes(spark):
    bits = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(bits,), ([3] + [0] * 15,)], "b array<int>")
    good, bad = [r.c for r in df.select(huffman.canonical_codes(F.col("b")).alias("c")).collect()]
    assert [c.code for c in good] == [0, 2, 3, 4, 5, 6, 14, 30, 62, 126, 254, 510] and bad is None


def test_varints(spark):
    df = spark.createDataFrame([([0x05, 0x81, 0x00, 0xFF, 0x7F],), ([0x81],), ([],)], "b array<bigint>")
    assert [r.v for r in df.select(huffman.varints(F.col("b")).alias("v")).collect()] == [[5, 128, 16383], None, []]
    assert [r.o for r in spark.createDataFrame([(b"\x00\xff\x10",), (b"",)], "b binary").select(huffman.octets(F.col("b")).alias("o")).collect()] == [[0, 255, 16], []]


def test_zigzag_and_basis(spark):
    assert dct.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(dct.ZIGZAG) == list(range(64))
    b = np.array([[dct.basis(k, i) for i in range(8)] for k in range(8)])
    assert np.allclose(b @ b.T, np.eye(8))
    assert one(spark, dct.dc_only_pixel(F.col("v")), v=-900) == 16


def test_predictors_and_colour(spark):
    got = [one(spark, resample.lossless_predict(F.col("p"), F.lit(5), F.lit(8), F.lit(11)), p=p) for p in range(1, 8)]
    assert got == [5, 8, 11, 2, 3, 5, 6]
    assert one(spark, color.sign_extend(F.col("v"), 5), v=0b10110) == -10
    assert one(spark, F.array(*color.sample_range(F.col("b"), F.lit(True))), b=8) == [-128, 127]
    assert one(spark, color.level_shift(F.col("b"), F.lit(False)), b=12) == 2048


def test_published_error_vector(spark):
    df = spark.createDataFrame(list(zip([10, 3, -4, 9, 8], [10, 1, -3, 8, 10])), "a bigint, b bigint")
    m = metrics.error_metrics(df, "a", "b").first()
    assert (m.total, m.exact, m.max_abs, int(m.squares)) == (5, 1, 2, 10)
    assert {r.abs_error: r.n for r in metrics.histogram(df, "a", "b").collect()} == {0: 1, 1: 2, 2: 2}
    assert one(spark, metrics.exact_rate(F.col("z"), F.col("z")), z=0) == 1.0


def slow_layers(rows, targets):
    """The method as told: look at all blocks' next segments each time."""
    limits = [x + max(512, x // 100) for x in targets]
    used, left, least, out = [0] * len(targets), {}, {}, {}
    for r in sorted(rows):
        left.setdefault(r[0], []).append(r)
    while any(left.values()):
        b, s, n, d = min((q[0] for q in left.values() if q), key=lambda r: (-(math.inf if r[2] == 0 else r[3] / r[2]), r[0], r[1]))
        left[b].pop(0)
        layer = len(targets) - 1
        for i in range(least.get(b, 0), len(targets) - 1):
            if all(used[j] + n <= limits[j] for j in range(i, len(targets))):
                layer = i
                break
        for j in range(layer, len(targets)):
            used[j] += n
        least[b] = out[b, s] = layer
    return out


def test_layers_by_slope(spark):
    rng = random.Random(3)
    rows = [(b, s, rng.randrange(0, 400), rng.random() * 1000) for b in range(12) for s in range(rng.randrange(1, 9))]
    want = slow_layers(rows, [800, 3000, 9000])
    df = spark.createDataFrame([(t, *r) for t in (1, 2) for r in rows], "tile int, block bigint, segment bigint, rate bigint, distortion double")
    got = rate.layers_by_slope(df, [800, 3000, 9000], ["tile"]).collect()
    assert len(got) == 2 * len(rows) and all(r.layer == want[r.block, r.segment] for r in got) and len(set(want.values())) == 3
    assert all(want[b, s] <= want[b, s + 1] for b, s in want if (b, s + 1) in want)


def test_rate_searches():
    planes = image(9, 40, 40, 1, 8)
    data = rate.encode_to_size(planes, 700, levels=2, block=4)
    assert len(data) <= 700 + 512
    with pytest.raises(rate.Unreachable):
        rate.to_size(lambda s: bytes(5000), 100)
    data = rate.encode_to_psnr(planes, 38.0, levels=2, block=4)
    assert 37.9 <= rate.psnr(planes, data, 255) < 45
    with pytest.raises(rate.Unreachable):
        rate.to_psnr(lambda s: b"", lambda d: 20.0, 30.0)


def test_palette_override_and_passthrough(spark):
    df = spark.createDataFrame([(0, 1), (1, -1), (2, 3), (3, None)], "id int, i bigint").withColumn("e", F.array(*map(F.lit, (7, 8, 9))))
    got = {r.id: (r.value, r.error) for r in batches.palette_lookup(df, F.col("e"), F.col("i")).collect()}
    assert got == {0: (8, None), 1: (None, "palette_index"), 2: (None, "palette_index"), 3: (None, "palette_index")}
    source = {"size": F.lit(5), "syntax": F.lit("a"), "kind": F.lit("k"), "components": F.lit(3)}
    wanted = {"syntax": F.lit("a"), "kind": F.lit("k"), "components": F.lit(None).cast("int")}
    assert one(spark, batches.passthrough_reason(source, wanted)) is None
    assert one(spark, batches.passthrough_reason(source | {"size": F.lit(0)}, wanted)) == "empty_payload"


def test_byte_queries(spark):
    rows = catalogue.jpeg2000_round_trip(spark, SF).collect()
    assert rows and all(r.same and r.error is None and r.format == "jp2" and r.levels == 2 for r in rows)
    assert sum(r.blocks for r in catalogue.jpeg_blocks(spark, SF).collect()) == len(rows)
    n = {r.name: r.n for r in catalogue.box_walk(spark, SF).collect()}
    assert n["jp2c"] == n["SIZ"] == n["EOC"] == len(rows)
    assert catalogue.layer_assign_classic(spark, SF).count()


def test_awkward_pixels_and_rules(spark):
    from rasterloom.functions import packets, packing
    from rasterloom.operators import grids

    d = spark.createDataFrame([(1, [[1, 2], [3, 4]], [5, 6, 7]), (2, [[], []], []), (3, None, None)], "id int, planes array<array<bigint>>, odd array<bigint>")
    got = {r.id: r for r in d.select("id", packing.interleave(F.col("planes")).alias("a"), packing.deinterleave(F.col("odd"), 2, 8).alias("b")).collect()}
    assert got[1].a == [1, 3, 2, 4] and got[1].b is None
    assert got[2].a == [] and got[2].b == [[], []] and got[3].a is None and got[3].b is None
    with pytest.raises(ValueError):
        packing.strided(F.col("odd"), 4, 3)
    w = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 9, 9, 9, 12), (1, 6, 2, 8, 3), (2, 5, 5, 5, 5)], "image int, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in grids.window_union(w, "image").collect()] == [(1, 0, 0, 8, 4)]
    blocks = spark.createDataFrame([(1, 0, 0, 8, 8), (1, 8, 0, 16, 8), (2, 0, 0, 8, 8)], "image int, x0 int, y0 int, x1 int, y1 int")
    assert [tuple(r) for r in grids.required_blocks(blocks, grids.window_union(w, "image"), "image").collect()] == [(1, 0, 0, 8, 8)]
    v = spark.createDataFrame([(5, 70), (5, 62), (-(1 << 62), 62), (None, 3), (-9, 3)], "v bigint, shift int")
    assert [r[0] for r in v.select(packets.roi_unshift(F.col("v"), F.col("shift"))).collect()] == [5, 5, -1, None, -1]
    assert spark.range(1).select(packets.samples_per_image(F.lit(1 << 40), F.lit(1 << 40), F.lit(1)), packets.bits_per_pixel(F.lit(3), F.lit(0), F.lit(4))).first()[:] == (None, None)


def test_blocks_of_windows_without_a_row_each(spark):
    """Blocks of images are neither exploded nor broadcast; those of edges, of windows off the image and of an image told twice count."""
    from rasterloom.operators import grids

    plan = catalogue.roi_block_windows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastHashJoin" not in plan
    images = spark.createDataFrame([(1, 130, 64), (2, 128, 65), (2, 200, 65), (3, 64, 64), (4, 64, 64), (5, 640, 640)], "image_id bigint, grid_w bigint, grid_h bigint")
    windows = spark.createDataFrame([(1, 63, -5, 129, 64), (2, 64, 64, 900, 900), (3, 64, 0, 80, 9), (4, -9, -9, 0, 5), (5, 128, 64, 129, 192)], "image_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    cells = [F.explode(F.expr(f"sequence(0l, ({n} - 1) div 64)")).alias(c) for n, c in (("grid_w", "gx"), ("grid_h", "gy"))]
    blocks = images.select("*", cells[0]).select("*", cells[1]).selectExpr("image_id", "grid_w", "gx * 64 as x0", "gy * 64 as y0", "least(gx * 64 + 64, grid_w) as x1", "least(gy * 64 + 64, grid_h) as y1")
    needed = grids.required_blocks(blocks, windows, "image_id")
    assert "Broadcast" not in needed._jdf.queryExecution().executedPlan().toString()
    want = needed.groupBy("image_id", "grid_w").agg(F.count("*"), F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).drop("grid_w")
    got = [tuple(r) for r in grids.block_ranges(images, windows).collect()]
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) == 4
    requests = spark.createDataFrame([(7, 1, 0, 0, 9, 9, 0)], "req bigint, image_id bigint, x bigint, y bigint, w bigint, h bigint, levels bigint")
    sized = images.selectExpr("*", "64l as tile_w", "64l as tile_h", "1l as nl")
    for found in (grids.decode_plans(sized, requests), grids.tiles_of_regions(sized, requests)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_images_are_dealt_before_they_are_exploded(spark):
    """One file's images come to many tasks, and their groups meet without another exchange."""
    from rasterloom.operators import grids

    images = spark.range(0, 1000, 1, 1).withColumnRenamed("id", "image_id")
    assert grids.dealt(images, most=20).rdd.getNumPartitions() == 50
    for name in ("resolution_ladder", "precinct_counts", "codeblock_grid"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.rindex("Generate") < plan.index("Exchange"), name  # the plan is written from its end


def test_layers_by_slope_are_streamed(spark):
    """A tile isn't held; ties, empty segments, late steep ones and tiles over many batches come as told."""
    rng = random.Random(8)
    rows = [(b, s, rng.choice([0, 7, 40, 90]), float(rng.choice([0, 0, 50, 90, 400]))) for b in range(25) for s in range(rng.randrange(1, 12))]
    want = slow_layers(rows, [300, 1500, 4000])
    mixed = [(t, f"b{r[0]:02}", *r[1:]) for t in ("x", "y", "z") for r in rows]
    rng.shuffle(mixed)
    df = spark.createDataFrame(mixed, "tile string, block string, segment int, rate bigint, distortion double")
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        out = rate.layers_by_slope(df, [300, 1500, 4000], ["tile"])
        got = out.collect()
    finally:
        spark.conf.set(key, old)
    assert out.dtypes == [("tile", "string"), ("block", "string"), ("segment", "int"), ("layer", "int")]
    assert len(got) == len(mixed) and all(r.layer == want[int(r.block[1:]), r.segment] for r in got) and set(want.values()) == {0, 1, 2}
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
    unknown = spark.createDataFrame([(1, 1, 0, None, 5.0), (1, 1, 1, 10, 5.0)], "tile int, block bigint, segment bigint, rate bigint, distortion double")
    assert {r.segment: r.layer for r in rate.layers_by_slope(unknown, [300, 1500, 4000], ["tile"]).collect()} == {0: 2, 1: 2}
