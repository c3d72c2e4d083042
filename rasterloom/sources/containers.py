"""Formats, boxes, markers and segments of image files, without decoding samples."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic bytes (fixed values of the formats).
CODESTREAM, JP2_SIGNATURE, JPEG = bytes.fromhex("ff4fff51"), bytes.fromhex("0000000c6a5020200d0a870a"), bytes.fromhex("ffd8ff")
#: Marker codes of the codestream (fixed values).
MARKERS = {
    0x4F: "SOC", 0x50: "CAP", 0x51: "SIZ", 0x52: "COD", 0x53: "COC", 0x55: "TLM", 0x57: "PLM", 0x58: "PLT", 0x59: "CPF", 0x5C: "QCD", 0x5D: "QCC", 0x5E: "RGN", 0x5F: "POC", 0x60: "PPM", 0x61: "PPT",
    0x63: "CRG", 0x64: "COM", 0x90: "SOT", 0x91: "SOP", 0x92: "EPH", 0x93: "SOD", 0xD9: "EOC"}
SUPERBOXES = (b"jp2h", b"res ", b"uinf")
PREFIX = 64 << 20


class Malformed(ValueError):
    """Input that breaks its format; becomes an error row."""


def read_images(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of image files; a file a row."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def format_of(content: Column) -> Column:
    """codestream, jp2, jpeg or unsupported, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith(CODESTREAM.hex().upper()), "codestream").when(head == JP2_SIGNATURE.hex().upper(), "jp2").when(head.startswith(JPEG.hex().upper()), "jpeg").otherwise("unsupported")


def prefix(content: Column, limit: int = PREFIX) -> Column:
    """At most ``limit`` bytes, and whether some are left out."""
    return F.struct(F.substring(content, 1, limit).alias("bytes"), (F.octet_length(content) > limit).alias("truncated"))


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, str, int, int]]:
    """(depth, type, offset and length of the body)."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Malformed("truncated box")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("truncated box")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise Malformed("box leaves its parent")
        yield depth, kind.decode("latin-1"), body, stop - body
        if kind in SUPERBOXES and depth < 8:
            yield from boxes(data, body, stop, depth + 1)
        start = stop


def container(data: bytes) -> dict:
    """Header facts of a JP2 or JPH file: kind, image header, depths, colour, palette, channels, and where the codestream is."""
    if data[:12] != JP2_SIGNATURE:
        raise Malformed("no JP2 signature")
    out: dict = {"kind": None, "offset": None, "length": None, "depths": [], "enum_colour": None, "icc": None, "palette": None, "mapping": [], "channels": []}
    for depth, kind, at, n in boxes(data):
        body = data[at : at + n]
        if kind == "ftyp":
            out["kind"] = "jph" if body[:4] == b"jph " else "jp2"
        elif kind == "jp2c" and out["offset"] is None:
            out["offset"], out["length"] = at, n
        elif depth == 1:
            try:
                _header_box(out, kind, body)
            except (struct.error, IndexError) as e:
                raise Malformed(f"short {kind} box") from e
    if out["kind"] is None or out["offset"] is None or "width" not in out:
        raise Malformed("a required box is missing")
    return out


def _depth(b: int) -> dict:
    return {"bits": (b & 127) + 1, "signed": b > 127}


def _header_box(out: dict, kind: str, body: bytes) -> None:
    if kind == "ihdr":
        out["height"], out["width"], out["components"], bpc = struct.unpack(">IIHB", body[:11])
        out["depths"] = out["depths"] or ([] if bpc == 255 else [_depth(bpc)] * out["components"])
    elif kind == "bpcc":
        out["depths"] = [_depth(b) for b in body]
    elif kind == "colr" and out["enum_colour"] is None and out["icc"] is None:
        if body[0] == 1:
            out["enum_colour"] = struct.unpack_from(">I", body, 3)[0]
        elif body[0] == 2:
            out["icc"] = {"space": body[19:23].decode("latin-1").strip(), "size": len(body) - 3}
    elif kind == "pclr":
        n, columns = struct.unpack_from(">HB", body)
        depths, at, rows = [_depth(b) for b in body[3 : 3 + columns]], 3 + columns, []
        for _ in range(n):
            row = []
            for d in depths:
                size = -(-d["bits"] // 8)
                if at + size > len(body):
                    raise IndexError
                row.append(int.from_bytes(body[at : at + size], "big"))
                at += size
            rows.append(row)
        out["palette"] = rows
    elif kind == "cmap":
        out["mapping"] = [dict(zip(("component", "palette", "column"), x, strict=True)) for x in struct.iter_unpack(">HBB", body)]
    elif kind == "cdef":
        out["channels"] = [dict(zip(("channel", "type", "association"), x, strict=True)) for x in struct.iter_unpack(">HHH", body[2 : 2 + 6 * struct.unpack_from(">H", body)[0]])]


def markers(data: bytes, offset: int = 0) -> Iterator[tuple[str, int, int]]:
    """(name, offset and length of the payload) from SOC to EOC; the body of a tile-part is skipped by its SOT."""
    if data[offset : offset + 2] != CODESTREAM[:2]:
        raise Malformed("no SOC")
    yield "SOC", offset + 2, 0
    at, part_end = offset + 2, None
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise Malformed("no marker where one belongs")
        name = MARKERS.get(data[at + 1], "UNKNOWN")
        if name == "EOC":
            yield name, at + 2, 0
            return
        if name == "SOD":
            if part_end is None:
                raise Malformed("SOD without SOT")
            end = part_end if part_end else max(len(data) - 2, at + 2)
            yield name, at + 2, end - at - 2
            at, part_end = end, None
            continue
        if at + 4 > len(data):
            raise Malformed("truncated marker")
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise Malformed("truncated marker")
        yield name, at + 4, size - 2
        if name == "SOT":
            length = struct.unpack_from(">I", data, at + 6)[0]
            part_end = at + length if length else 0
            if part_end and not at + 14 <= part_end <= len(data):
                raise Malformed("tile-part leaves the codestream")
        at += 2 + size
    raise Malformed("no EOC")


def _style(body: bytes, precincts: bool) -> dict:
    levels, xcb, ycb, style, transform = struct.unpack_from(">5B", body)
    if levels > 32 or xcb > 8 or ycb > 8 or xcb + ycb > 8:
        raise Malformed("coding style out of range")
    sizes = list(body[5 : 6 + levels]) if precincts else [255] * (levels + 1)
    if len(sizes) != levels + 1:
        raise Malformed("precinct sizes are missing")
    return {"levels": levels, "xcb": xcb + 2, "ycb": ycb + 2, "style": style, "reversible": transform == 1, "ppx": [s & 15 for s in sizes], "ppy": [s >> 4 for s in sizes]}


def _quantizer(body: bytes) -> dict:
    kind, guard = body[0] & 31, body[0] >> 5
    if kind == 0:
        steps = [(b >> 3, 0) for b in body[1:]]
    else:
        steps = [(v >> 11, v & 2047) for (v,) in struct.iter_unpack(">H", body[1:])]
    return {"kind": kind, "guard": guard, "steps": steps}


def main_header(data: bytes, offset: int = 0) -> dict:
    """SIZ, COD, COC, QCD, QCC, POC, RGN of the main header, with component values resolved, and the tile-parts."""
    head: dict = {"coc": {}, "qcc": {}, "rgn": {}, "poc": [], "parts": [], "markers": []}
    tile = None
    try:
        for name, at, n in markers(data, offset):
            head["markers"].append(name)
            body = data[at : at + n]
            if name == "SOT":
                index, length, part, parts = struct.unpack(">HIBB", body)
                tile = {"tile": index, "part": part, "parts": parts, "length": length, "own": []}
                head["parts"].append(tile)
            elif name == "SOD" and tile is not None:
                tile["offset"], tile["size"] = at, n
                tile = None
            elif tile is not None:
                tile["own"].append((name, body))
            else:
                _main_marker(head, name, body)
    except (struct.error, IndexError) as e:
        raise Malformed("short marker") from e
    if not {"siz", "cod", "qcd"} <= set(head):
        raise Malformed("SIZ, COD or QCD is missing")
    flags = head["cod"]["flags"]
    head["styles"] = [head["coc"].get(c, head["cod"]) | {"flags": flags | head["coc"].get(c, {}).get("flags", 0)} for c in range(len(head["siz"]["components"]))]
    head["quantizers"] = [head["qcc"].get(c, head["qcd"]) for c in range(len(head["siz"]["components"]))]
    return head


def _main_marker(head: dict, name: str, body: bytes) -> None:
    wide = len(head.get("siz", {}).get("components", ())) > 256
    index = lambda: (struct.unpack_from(">H", body)[0], body[2:]) if wide else (body[0], body[1:])
    if name == "SIZ":
        caps, x1, y1, x0, y0, tw, th, tx, ty, n = struct.unpack_from(">HIIIIIIIIH", body)
        parts = [(_depth(b), xr, yr) for b, xr, yr in struct.iter_unpack(">BBB", body[36 : 36 + 3 * n])]
        if len(parts) != n or not 1 <= n <= 16384 or any(not xr or not yr for _, xr, yr in parts) or not (tw and th) or x1 <= x0 or y1 <= y0:
            raise Malformed("SIZ out of range")
        if -(-(x1 - tx) // tw) * -(-(y1 - ty) // th) > 65535:
            raise Malformed("too many tiles")
        head["siz"] = {"capabilities": caps, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "tile_w": tw, "tile_h": th, "tile_x": tx, "tile_y": ty, "components": [d | {"xr": xr, "yr": yr} for d, xr, yr in parts]}
    elif name == "COD":
        flags, order, layers, mct = struct.unpack_from(">BBHB", body)
        head["cod"] = {"flags": flags, "order": order, "layers": layers, "mct": mct} | _style(body[5:], bool(flags & 1))
    elif name == "COC":
        c, rest = index()
        head["coc"][c] = {"flags": rest[0]} | _style(rest[1:], bool(rest[0] & 1))
    elif name == "QCD":
        head["qcd"] = _quantizer(body)
    elif name == "QCC":
        c, rest = index()
        head["qcc"][c] = _quantizer(rest)
    elif name == "RGN":
        c, rest = index()
        if rest[0]:
            raise Malformed("unknown region style")
        head["rgn"][c] = rest[1]
    elif name == "POC":
        code = ">BHHBHB" if wide else ">BBHBBB"
        size = struct.calcsize(code)
        if len(body) % size:
            raise Malformed("POC length")
        head["poc"] += [dict(zip(("res0", "comp0", "layer1", "res1", "comp1", "order"), x, strict=True)) for x in struct.iter_unpack(code, body)]


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, offset and length of the payload) of a JPEG; entropy-coded bytes are skipped."""
    if data[:2] != JPEG[:2]:
        raise Malformed("no SOI")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise Malformed("no marker where one belongs")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            break
        marker = data[at]
        at += 1
        if marker == 0xD9:
            yield marker, at, 0
            return
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(data):
            raise Malformed("truncated segment")
        size = struct.unpack_from(">H", data, at)[0]
        if size < 2 or at + size > len(data):
            raise Malformed("truncated segment")
        yield marker, at + 2, size - 2
        at += size
        if marker == 0xDA:
            at = entropy_end(data, at)


def entropy_end(data: bytes, at: int) -> int:
    """Where the next marker is that is neither stuffing nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return at


def is_sof(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


def jpeg_header(data: bytes) -> dict:
    """Frame, restart interval (null for 0), Adobe transform and the first scan's byte ranges."""
    out: dict = {"interval": None, "adobe": None, "sof": None, "scan": None}
    try:
        for marker, at, n in segments(data):
            if is_sof(marker) and out["sof"] is None:
                bits, height, width, count = struct.unpack_from(">BHHB", data, at)
                parts = [{"id": c, "h": hv >> 4, "v": hv & 15, "table": q} for c, hv, q in struct.iter_unpack(">BBB", data[at + 6 : at + 6 + 3 * count])]
                if n != 6 + 3 * count or not count or any(not (1 <= p["h"] <= 4 and 1 <= p["v"] <= 4) for p in parts):
                    raise Malformed("frame header out of range")
                out["sof"] = {"marker": marker, "bits": bits, "height": height, "width": width, "components": parts, "offset": at}
            elif marker == 0xDD:
                if n != 2:
                    raise Malformed("restart interval length")
                out["interval"] = struct.unpack_from(">H", data, at)[0] or None
            elif marker == 0xEE and data[at : at + 5] == b"Adobe" and n >= 12:
                out["adobe"] = data[at + 11]
            elif marker == 0xDA and out["scan"] is None:
                end = entropy_end(data, at + n)
                out["scan"] = {"marker": at - 4, "payload": (at, at + n), "entropy": (at + n, end), "eoi": end if data[end : end + 2] == b"\xff\xd9" else None}
    except struct.error as e:
        raise Malformed("short segment") from e
    if out["sof"] is None:
        raise Malformed("no frame header")
    return out


def with_size(data: bytes, width: int, height: int) -> bytes:
    """A JPEG with other dimensions in its frame header."""
    at = jpeg_header(data)["sof"]["offset"]
    return data[: at + 1] + struct.pack(">HH", height, width) + data[at + 5 :]


def with_tables(tile: bytes, tables: bytes) -> bytes:
    """An abbreviated tile with the shared tables put behind its SOI."""
    if tile[:2] != JPEG[:2] or tables[:2] != JPEG[:2]:
        raise Malformed("no SOI")
    kept = b"".join(data_of(tables, m, at, n) for m, at, n in segments(tables) if m in (0xDB, 0xC4))
    return tile[:2] + kept + tile[2:]


def data_of(data: bytes, marker: int, at: int, n: int) -> bytes:
    return data[at - 4 : at + n]


def read_pgx(data: bytes) -> dict:
    """A PGX image: exact payload, samples within their precision."""
    line, found, payload = data.partition(b"\n")
    words = line.rstrip(b"\r").decode("latin-1").split(" ")
    words = [w for w in words if w]
    if not found or len(words) < 2 or words[0] != "PG" or words[1] not in ("ML", "LM"):
        raise Malformed("PGX header")
    rest = words[2:]
    signed = bool(rest) and rest[0].startswith("-")
    if rest and rest[0] in ("+", "-"):
        rest = rest[1:]
    elif rest:
        rest[0] = rest[0].lstrip("+-")
    if len(rest) != 3 or not all(r.isdigit() for r in rest):
        raise Malformed("PGX header")
    bits, width, height = map(int, rest)
    if not 1 <= bits <= 32 or not width or not height:
        raise Malformed("PGX header")
    size = 1 if bits <= 8 else 2 if bits <= 16 else 4
    if len(payload) != width * height * size:
        raise Malformed("PGX payload")
    order = "big" if words[1] == "ML" else "little"
    values = [int.from_bytes(payload[i : i + size], order, signed=signed) for i in range(0, len(payload), size)]
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    if any(not low <= v <= high for v in values):
        raise Malformed("PGX sample out of range")
    return {"bits": bits, "signed": signed, "width": width, "height": height, "samples": values}


def write_pgx(image: dict) -> bytes:
    size = 1 if image["bits"] <= 8 else 2 if image["bits"] <= 16 else 4
    head = f"PG ML {'-' if image['signed'] else '+'}{image['bits']} {image['width']} {image['height']}\n".encode()
    return head + b"".join(v.to_bytes(size, "big", signed=image["signed"]) for v in image["samples"])


def rows_of(df: DataFrame, kernel: Callable[[bytes], Iterator[tuple]], names: str, content: str = "content", key: str = "path") -> DataFrame:
    """A row for each tuple that the kernel gives of a file; malformed input gives an error row instead of failing the job."""
    fields = [f.split(" ", 1) for f in names.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows, errors = [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                at = len(rows)
                try:
                    rows += kernel(data or b"")
                    errors += [None] * (len(rows) - at)
                except ValueError as e:
                    del rows[at:]
                    rows.append((None,) * len(fields))
                    errors.append(str(e))
                which += [i] * (len(rows) - at)
            columns = [pa.array([r[j] for r in rows], kinds[t]) for j, (_, t) in enumerate(fields)]
            yield pa.record_batch([batch.column(0).take(pa.array(which, pa.int64())), *columns, pa.array(errors, pa.string())], names=[key, *(n for n, _ in fields), "error"])

    return df.select(key, F.col(content).cast("binary")).mapInArrow(run, f"{key} {key_type}, {names}, error string")


def box_rows(df: DataFrame, **how) -> DataFrame:
    return rows_of(df, boxes, "depth int, type string, offset bigint, length bigint", **how)


def marker_rows(df: DataFrame, **how) -> DataFrame:
    def kernel(data: bytes) -> Iterator[tuple]:
        return markers(data, container(data)["offset"] if data[:12] == JP2_SIGNATURE else 0)

    return rows_of(df, kernel, "marker string, offset bigint, length bigint", **how)


def segment_rows(df: DataFrame, **how) -> DataFrame:
    return rows_of(df, segments, "marker int, offset bigint, length bigint", **how)


def inspect(df: DataFrame, **how) -> DataFrame:
    """Format, size, components, depth, tiles, levels, transform and order of each file, from headers alone."""

    def kernel(data: bytes) -> Iterator[tuple]:
        if data[:3] == JPEG:
            h = jpeg_header(data)
            s = h["sof"]
            yield "jpeg", s["width"], s["height"], len(s["components"]), s["bits"], False, None, None, None, None, h["interval"]
            return
        box = container(data) if data[:12] == JP2_SIGNATURE else None
        h = main_header(data, box["offset"] if box else 0)
        s, c = h["siz"], h["cod"]
        tiles = -(-(s["x1"] - s["tile_x"]) // s["tile_w"]) * -(-(s["y1"] - s["tile_y"]) // s["tile_h"])
        first = s["components"][0]
        yield box["kind"] if box else "codestream", s["x1"] - s["x0"], s["y1"] - s["y0"], len(s["components"]), first["bits"], first["signed"], tiles, c["levels"], c["reversible"], ("lrcp", "rlcp", "rpcl", "pcrl", "cprl")[min(c["order"], 4)], None

    return rows_of(df, kernel, "format string, width bigint, height bigint, components int, bits int, signed boolean, tiles bigint, levels int, reversible boolean, progression string, restart_interval int", **how)


def wrap(codestream: bytes, kind: str = "jp2", enum_colour: int | None = None) -> bytes:
    """A JP2 or JPH file around a codestream; JP2 takes no high-throughput blocks, JPH no others."""
    h = main_header(codestream)
    if (kind == "jph") != ("CAP" in h["markers"]):
        raise Malformed(f"{kind} does not take this codestream")
    s = h["siz"]
    parts = s["components"]
    same = all((p["bits"], p["signed"]) == (parts[0]["bits"], parts[0]["signed"]) for p in parts)
    depth = [p["bits"] - 1 | (128 if p["signed"] else 0) for p in parts]

    def box(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I4s", len(body) + 8, name) + body

    head = box(b"ihdr", struct.pack(">IIHBBBB", s["y1"] - s["y0"], s["x1"] - s["x0"], len(parts), depth[0] if same else 255, 7, 0, 0))
    head += b"" if same else box(b"bpcc", bytes(depth))
    head += box(b"colr", struct.pack(">BBBI", 1, 0, 0, enum_colour or (16 if len(parts) >= 3 else 17)))
    brand = b"jph " if kind == "jph" else b"jp2 "
    return JP2_SIGNATURE + box(b"ftyp", brand + bytes(4) + brand) + box(b"jp2h", head) + box(b"jp2c", codestream)
