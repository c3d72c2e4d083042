import hashlib
import struct
import zlib
from collections import Counter

import pytest

from rasterloom.llm import media

from .helpers import awkward, empty, frame


def test_round_trip(spark):
    rows = media.read_media(media.store_texts(frame(spark))).collect()
    want = Counter()
    for doc, text, *_ in awkward():
        raw = (text or "").encode()
        padded = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        stored = media.mux(padded)
        want[doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == want
    assert all(r.error is None and r.codec == "raw " and r.duration == 25 * r.samples for r in rows)
    assert all(len(r.keyframes) == -(-r.samples // media.KEY_EVERY) for r in rows)
    assert media.read_media(media.store_texts(empty(spark))).collect() == []
    key = lambda r: repr(r)
    assert sorted(media.text_media(frame(spark)).collect(), key=key) == sorted(rows, key=key)
    assert media.text_media(empty(spark)).collect() == []


def test_samples_and_tables():
    payload = bytes(range(256)) * 9 * 20  # 80 frames
    data = media.mux(payload)
    (track,) = media.tracks(data)
    assert [o for o, _, _, _ in track["samples"]] == list(range(data.index(b"mdat") + 4, data.index(b"mdat") + 4 + len(payload), 576))
    assert [i for i, s in enumerate(track["samples"]) if s[3]] == list(range(0, 80, media.KEY_EVERY))
    assert media.payload_of(data, track["samples"]) == payload
    kinds = [k for _, k, _, _ in media.walk(data)]
    assert kinds[:4] == [b"ftyp", b"moov", b"mvhd", b"trak"] and b"stco" in kinds


def test_other_tables():
    sizes, offsets = [3, 5, 2], [40, 48]
    stbl = media.box(b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), media.full(b"stts", 0, 0, struct.pack(">5I", 2, 2, 10, 1, 7)),
                     media.full(b"stsc", 0, 0, struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stsz", 0, 0, struct.pack(">5I", 0, 3, *sizes)), media.full(b"co64", 0, 0, struct.pack(">IQQ", 2, *offsets)))
    mdhd = media.full(b"mdhd", 1, 0, struct.pack(">QQIQI", 0, 0, 1000, 27, 0))
    data = media.box(b"free", bytes(60)) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    (t,) = media.tracks(data)
    assert (t["codec"], t["timescale"], t["duration"]) == ("mp4a", 1000, 27)
    assert t["samples"] == [(40, 3, 10, True), (43, 5, 10, True), (48, 2, 7, True)]


@pytest.mark.parametrize("data", [b"", b"\0\0\0", struct.pack(">I4s", 100, b"moov"), media.box(b"moov", media.box(b"trak", media.full(b"stts", 0, 0, struct.pack(">I", 9)))), media.mux(bytes(576))[:-1], b"\0\0\0\1moov"])
def test_broken_containers_give_errors(spark, data):
    (row,) = media.read_media(spark.createDataFrame([(1, 0, data)], "doc_id bigint, n_bytes bigint, media binary")).collect()
    assert row.error and row.payload_bytes is None and row.media_bytes == len(data)
