import numpy as np
import pytest

from rasterloom.codec import jpeg, jpeg2000
from rasterloom.operators import images
from rasterloom.sources import containers

from .test_jpeg2000 import image


@pytest.mark.parametrize("subsample,interval,shape", [((1, 1), 0, (30, 41)), ((2, 1), 3, (33, 50)), ((2, 2), 2, (35, 29)), ((1, 1), 0, (1, 1))])
def test_round_trip(subsample, interval, shape):
    for n in (1, 3):
        planes = image(1, *shape, n, 8)
        planes = planes if n == 1 else [planes[0], planes[0] // 2 + 30, 255 - planes[0]]
        data = jpeg.encode(planes, quality=97, subsample=subsample, interval=interval)
        got = jpeg.decode(data)
        assert all(a.shape == b.shape for a, b in zip(got, planes))
        assert all(np.abs(a - b).mean() < (4 if subsample == (1, 1) else 9) for a, b in zip(got, planes))
        assert containers.jpeg_header(data)["interval"] == (interval or None)


def test_integer_idct_is_close_to_exact():
    rng = np.random.default_rng(0)
    blocks = rng.integers(-60, 61, (200, 8, 8))
    exact = np.einsum("nkl,ki,lj->nij", blocks.astype(float), jpeg.BASIS, jpeg.BASIS) + 128
    assert np.abs(jpeg.idct_islow(blocks) - np.clip(exact, 0, 255)).max() <= 1.01
    flat = np.zeros((5, 8, 8), int)
    flat[:, 0, 0] = [-900, -8, 0, 100, 3000]
    assert (jpeg.idct_islow(flat)[:, 3, 3] == jpeg.idct_scaled(flat, 1)[:, 0, 0]).all()


def test_reduced_sizes():
    plane = image(2, 40, 48, 1, 8)
    data = jpeg.encode(plane, quality=95)
    for size in (4, 2, 1):
        got = jpeg.decode(data, size)[0]
        want = plane[0].reshape(5 * size, 8 // size, 6 * size, 8 // size).mean(axis=(1, 3))
        assert got.shape == want.shape and np.abs(got - want).mean() < 4


def test_prefix_codes():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 200):
        counts = {int(s): int(c) for s, c in zip(rng.permutation(256)[:n], 2 ** rng.integers(0, 30, n))}
        per, values = jpeg.code_lengths(counts)
        assert sum(per) == n == len(values) and sum(c / 2**i for i, c in enumerate(per, 1)) < 1
        table = jpeg.lookup(per, values)
        assert {v for length, v in table if length} == set(counts)


def test_rows(spark):
    grey, colour = image(5, 20, 24, 1, 8), image(6, 17, 19, 3, 8)
    rows = [("a", jpeg.encode(grey)), ("b", jpeg2000.encode(colour, levels=2, block=4)), ("c", b"junk"), ("d", None), ("e", jpeg.encode(grey)[:-60])]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {}
    for r in images.decode_images(df).collect():
        got.setdefault(r.path, []).append(r)
    assert [len(got[k]) for k in "abcd"] == [1, 3, 1, 1] and got["c"][0].error and got["d"][0].error
    for r in got["b"]:
        assert (np.array(r.samples).reshape(r.height, r.width) == colour[r.component]).all()
    part = spark.createDataFrame([("b", rows[1][1], (2, 3, 5, 6), 0), ("b2", rows[1][1], (0, 0, 0, 1), 0), ("b3", rows[1][1], None, 9)], "path string, content binary, roi struct<x:int,y:int,w:int,h:int>, k int")
    out = {r.path: r for r in images.decode_images(part, region="roi", reduce="k").filter("component = 0 or error is not null").collect()}
    assert (np.array(out["b"].samples).reshape(6, 5) == colour[0][3:9, 2:7]).all() and out["b2"].error and out["b3"].error
    made = images.encode_images(spark.createDataFrame([("x", 24, 20, [grey[0].ravel().tolist()]), ("y", 5, 5, [[1]])], "image string, width int, height int, planes array<array<bigint>>"), kind="jp2", levels=2)
    back = {r.image: r for r in made.collect()}
    assert (jpeg2000.decode(bytes(back["x"].content))["planes"][0] == grey[0]).all() and back["y"].error
    recoded = {r.path: r for r in images.jpeg_to_jpeg2000(df, levels=2).collect()}
    assert (jpeg2000.decode(bytes(recoded["a"].content))["planes"][0] == jpeg.decode(rows[0][1])[0]).all() and recoded["c"].error
    blocks = images.dct_blocks(df.filter("path in ('a', 'c')"))
    want = jpeg.coefficients(rows[0][1])["components"][0]["blocks"]
    assert all(r.coeff == want[r.by, r.bx].tolist() for r in blocks.filter("path = 'a'").collect())
    assert blocks.filter("path = 'c'").first().error
    assert images.wrap_images(df).filter("path = 'b'").first().content[4:8] == b"jP  "
