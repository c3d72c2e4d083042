import numpy as np
import pytest

from rasterloom.codec import blocks, jpeg2000
from rasterloom.sources import containers

# the arithmetic coder's published test sequence
PLAIN = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
CODED = bytes.fromhex("84C73BFCE1A14304022000 00410DBB86F4317FFF88FF37471ADB6ADFFFAC".replace(" ", ""))


def test_arithmetic_coder():
    e = blocks.Encoder()
    e.index = [0] * blocks.CONTEXTS
    for byte in PLAIN:
        for i in range(7, -1, -1):
            e.bit(byte >> i & 1, 0)
    out = e.flush()
    assert out.rstrip(b"\xff\xac") == CODED.rstrip(b"\xff\xac")
    d = blocks.Decoder(CODED)
    d.index = [0] * blocks.CONTEXTS
    got = bytes(sum(d.bit(0) << (7 - i) for i in range(8)) for _ in PLAIN)
    assert got == PLAIN


@pytest.mark.parametrize("band", ["LL", "HL", "LH", "HH"])
def test_blocks(band):
    rng = np.random.default_rng(1)
    for w, h, top in ((1, 1, 3), (4, 4, 9), (7, 9, 300), (64, 5, 2), (16, 16, 0)):
        v = rng.integers(-top, top + 1, (h, w))
        data, passes, planes = blocks.encode_block(v, band)
        back, missing = blocks.decode_block(data, passes, planes, w, h, band)
        assert (back == v).all() and not missing
        if passes > 3:  # fewer passes: an approximation
            part, missing = blocks.decode_block(data, passes - 3, planes, w, h, band)
            assert missing == 1 and (np.abs(part - v) <= 1).all()


def test_tag_tree_and_pass_counts():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, 35).tolist()
    bits = blocks.BitWriter()
    tree = blocks.TagTree(7, 5, values)
    for i in range(35):
        for t in range(1, values[i] + 2):
            tree.visit(i % 7, i // 7, t, bits)
    for n in range(1, 165):
        blocks.put_passes(bits, n)
    reader, tree = blocks.BitReader(bits.done(), 0), blocks.TagTree(7, 5)
    for i in range(35):
        t = 1
        while not tree.visit(i % 7, i // 7, t, reader):
            t += 1
        assert tree.leaf(i % 7, i // 7) == values[i] == t - 1
    assert [blocks.get_passes(reader) for _ in range(164)] == list(range(1, 165))


def image(seed, h, w, n, bits):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return [((np.sin(x / 5 + c) + np.cos(y / 7)) * (1 << bits - 3) + (1 << bits - 1) + rng.integers(-3, 4, (h, w))).astype(np.int64).clip(0, (1 << bits) - 1) for c in range(n)]


@pytest.mark.parametrize("order", jpeg2000.ORDERS)
@pytest.mark.parametrize("shape,n,levels,tile,precinct", [((33, 45), 1, 3, None, 15), ((40, 37), 3, 2, (16, 24), 15), ((50, 50), 2, 2, None, 4), ((1, 9), 1, 2, None, 15), ((23, 31), 4, 0, (31, 7), 15)])
def test_lossless_round_trip(order, shape, n, levels, tile, precinct):
    planes = image(3, *shape, n, 8)
    data = jpeg2000.encode(planes, levels=levels, order=order, block=4, tile=tile, precinct=precinct)
    got = jpeg2000.decode(data)
    assert all((a == b).all() for a, b in zip(got["planes"], planes))
    wrapped = containers.wrap(data)
    assert all((a == b).all() for a, b in zip(jpeg2000.decode(wrapped)["planes"], planes))


def test_regions_and_reduction():
    planes = image(4, 60, 70, 1, 12)
    data = jpeg2000.encode(planes, bits=12, levels=3, block=4, tile=(32, 32))
    assert (jpeg2000.decode(data, region=(13, 20, 40, 31))["planes"][0] == planes[0][20:51, 13:53]).all()
    full = jpeg2000.decode(data, reduce=2)["planes"][0]
    assert full.shape == (15, 18)
    part = jpeg2000.decode(data, reduce=2, region=(8, 12, 21, 30))["planes"][0]
    assert (part == full[3:11, 2:8]).all()
    for bad in ((0, 0, 0, 5), (60, 0, 20, 5), (-1, 0, 2, 2)):
        with pytest.raises(containers.Malformed):
            jpeg2000.decode(data, region=bad)
    with pytest.raises(containers.Malformed):
        jpeg2000.decode(data, reduce=4)


def test_lossy_is_close():
    planes = image(5, 48, 56, 3, 8)
    data = jpeg2000.encode(planes, reversible=False, levels=3, step=1 / 1024, block=5)
    got = jpeg2000.decode(data)["planes"]
    assert max(np.abs(a - b).max() for a, b in zip(got, planes)) <= 3
    assert len(jpeg2000.encode(planes, reversible=False, levels=3, step=1 / 32, block=5)) < len(jpeg2000.encode(planes, levels=3, block=5))


def test_signed_and_deep():
    rng = np.random.default_rng(6)
    planes = [rng.integers(-(1 << 15), 1 << 15, (12, 17))]
    assert (jpeg2000.decode(jpeg2000.encode(planes, bits=16, signed=True, levels=2))["planes"][0] == planes[0]).all()


def test_damage_is_an_error_or_an_image():
    data = jpeg2000.encode(image(7, 20, 20, 1, 8), levels=2, block=3)
    rng = np.random.default_rng(8)
    for _ in range(60):
        broken = bytearray(data)
        broken[rng.integers(len(data))] = rng.integers(256)
        try:
            jpeg2000.decode(bytes(broken[: rng.integers(2, len(data) + 1)]))
        except ValueError:
            pass
