import random
import struct
import zlib

import pytest

from rasterloom.sources import containers as c
from rasterloom.sources import tilecodecs as t


def codestream(tiles=1, body=b"\x80\x01"):
    siz = struct.pack(">HIIIIIIIIH", 0, 40, 30, 0, 0, 40, 30 // tiles if tiles > 1 else 30, 0, 0, 1) + bytes([7, 1, 1])
    cod = struct.pack(">BBHB", 0, 2, 1, 0) + bytes([3, 4, 4, 0, 1])
    qcd = bytes([0x40] + [8 << 3] * 10)
    out = bytes.fromhex("ff4f")
    for code, payload in ((0x51, siz), (0x52, cod), (0x5C, qcd), (0x64, b"\0\1note")):
        out += bytes([0xFF, code]) + struct.pack(">H", len(payload) + 2) + payload
    for i in range(tiles):
        out += b"\xff\x90" + struct.pack(">HHIBB", 10, i, 14 + len(body), 0, 1) + b"\xff\x93" + body
    return out + b"\xff\xd9"


def test_markers_and_header():
    data = codestream(2)
    assert [m[0] for m in c.markers(data)] == ["SOC", "SIZ", "COD", "QCD", "COM", "SOT", "SOD", "SOT", "SOD", "EOC"]
    h = c.main_header(data)
    assert h["cod"]["levels"] == 3 and h["cod"]["reversible"] and h["styles"][0]["xcb"] == 6
    assert [data[p["offset"] : p["offset"] + p["size"]] for p in h["parts"]] == [b"\x80\x01"] * 2
    assert h["qcd"]["steps"] == [(8, 0)] * 10 and h["qcd"]["guard"] == 2


def test_container():
    data = c.wrap(codestream())
    box = c.container(data)
    assert (box["kind"], box["width"], box["height"], box["components"], box["enum_colour"]) == ("jp2", 40, 30, 1, 17)
    assert data[box["offset"] : box["offset"] + box["length"]] == codestream()
    with pytest.raises(c.Malformed):
        c.wrap(codestream(), "jph")


def test_error_rows(spark):
    rng = random.Random(0)
    good = [codestream(), c.wrap(codestream(2))]
    bad = [b"", b"\xff\x4f\xff\x51", good[0][:60], good[1][:-20], bytes(40)]
    for _ in range(60):
        broken = bytearray(rng.choice(good))
        for _ in range(3):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        bad.append(bytes(broken[: rng.randrange(1, len(broken))]))
    df = spark.createDataFrame([(i, d) for i, d in enumerate(good + bad)], "path int, content binary")
    got = {r.path: r for r in c.inspect(df).collect()}
    assert len(got) == len(good + bad)
    assert (got[0].format, got[0].width, got[0].tiles, got[0].progression, got[0].error) == ("codestream", 40, 1, "rpcl", None)
    assert (got[1].format, got[1].tiles) == ("jp2", 2)
    assert all(got[i].error for i in range(2, 7))
    assert c.marker_rows(df).filter("path = 1 and marker = 'SOT'").count() == 2
    assert {r.type for r in c.box_rows(df).filter("path = 1").collect()} == {"jP  ", "ftyp", "jp2h", "ihdr", "colr", "jp2c"}
    kinds = [r[0] for r in df.orderBy("path").select(c.format_of(df.content)).collect()]
    assert kinds[:3] == ["codestream", "jp2", "unsupported"]


def test_jpeg_segments():
    sof = struct.pack(">BHHB", 8, 20, 30, 1) + bytes([1, 0x11, 0])
    seg = lambda m, p: bytes([0xFF, m]) + struct.pack(">H", len(p) + 2) + p
    data = b"\xff\xd8" + seg(0xDD, b"\0\4") + seg(0xC0, sof) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
    h = c.jpeg_header(data)
    assert (h["sof"]["width"], h["sof"]["height"], h["interval"]) == (30, 20, 4)
    a, b = h["scan"]["entropy"]
    assert data[a:b] == b"\x12\xff\x00\x34\xff\xd0\x56" and h["scan"]["eoi"] == b
    assert c.jpeg_header(c.with_size(data, 7, 9))["sof"]["height"] == 9
    tables = b"\xff\xd8" + seg(0xDB, bytes(65)) + b"\xff\xd9"
    assert [m for m, _, _ in c.segments(c.with_tables(data, tables))][:2] == [0xDB, 0xDD]
    for cut in range(2, len(data) - 2):
        try:
            c.jpeg_header(data[:cut])
        except c.Malformed:
            pass


def test_pgx():
    image = {"bits": 12, "signed": True, "width": 3, "height": 2, "samples": [-2048, 2047, 0, 5, -1, 9]}
    assert c.read_pgx(c.write_pgx(image)) == image
    assert c.read_pgx(b"PG LM + 9 1 2\n\x01\x00\xff\x01")["samples"] == [1, 511]
    for bad in (b"PG ML 8 2 2\n123", b"PG ML 4 1 1\n\x10", b"PG XX 8 1 1\n1", b"PG ML 8 1 1"):
        with pytest.raises(c.Malformed):
            c.read_pgx(bad)


def test_tile_codecs(spark):
    rng = random.Random(4)
    data = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 1, 5, 5000)] + [bytes(rng.randrange(256) for _ in range(9000))]
    rows = []
    for d in data:
        raw = zlib.compressobj(wbits=-15)
        rows += [("deflate", zlib.compress(d), len(d), d), ("deflate", raw.compress(d) + raw.flush(), len(d), d), ("lzw", t.lzw_encode(d), len(d), d), ("uncompressed", d, len(d), d)]
    rows += [("deflate", zlib.compress(data[3]), 4999, None), ("lzw", t.lzw_encode(data[3])[:-3], 5000, None), ("lzw", b"\xff\xff", 9, None), ("nope", b"", 0, None), ("uncompressed", b"a", 2, None), ("deflate", b"junk", 9, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "codec string, payload binary, size int, want binary")
    for r in t.decompress(df).collect():
        assert r.data == r.want and (r.error is None) == (r.want is not None or r.data is not None)


def test_zstd():
    zstandard = pytest.importorskip("zstandard")
    assert t.zstd(zstandard.compress(b"abc" * 100), 300) == b"abc" * 100
    with pytest.raises(t.TileError):
        t.zstd(zstandard.compress(b"abc" * 100), 299)


def test_stream(spark, tmp_path):
    from rasterloom.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.j2k").write_bytes(codestream())
    (tmp_path / "in/b.j2k").write_bytes(b"broken")
    q = ingest.inspected_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.table("seen").collect()}
    assert got["a.j2k"].width == 40 and got["b.j2k"].error
    planes = spark.createDataFrame([(1, [[1, 2], [3, 4], [5, 6]])], "image int, m array<array<int>>")
    assert [(r.stripe, r.y, r.row) for r in ingest.image_rows(planes, 2, 100).orderBy("y").collect()] == [(0, 0, [1, 2]), (0, 1, [3, 4]), (1, 2, [5, 6])]
    assert ingest.stripe_rows(10, 100, 64, 55) == 5
    with pytest.raises(ValueError):
        ingest.stripe_rows(10, 1, 1, 9)
