"""Sequential 8-bit JPEG: whole images to bytes and back, and their DCT blocks."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from ..functions.dct import ZIGZAG, basis
from ..sources.containers import Malformed, jpeg_header, segments

ORDER = np.array(ZIGZAG)
BASIS = np.array([[basis(k, i) for i in range(8)] for k in range(8)])
# fixed values: example tables for luminance and chrominance, by rows
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
# fixed values: the integer inverse DCT's factors with 13 fraction bits
F0298, F0390, F0541, F0765, F0899, F1175, F1501, F1847, F1961, F2053, F2562, F3072 = 2446, 3196, 4433, 6270, 7373, 9633, 12299, 15137, 16069, 16819, 20995, 25172


def _one_pass(x: list[np.ndarray], shift: int) -> list[np.ndarray]:
    """An 8-point inverse DCT of eight arrays, rounded down by ``shift`` bits."""
    even = (x[2] + x[6]) * F0541
    a, b = (x[0] + x[4]) << 13, (x[0] - x[4]) << 13
    c, d = even + x[2] * F0765, even - x[6] * F1847
    sums = [a + c, b + d, b - d, a - c]
    p, q, r, s = x[7], x[5], x[3], x[1]
    five = (p + r + q + s) * F1175
    z1, z2, z3, z4 = -(p + s) * F0899, -(q + r) * F2562, five - (p + r) * F1961, five - (q + s) * F0390
    odd = [s * F1501 + z1 + z4, r * F3072 + z2 + z3, q * F2053 + z2 + z4, p * F0298 + z1 + z3]
    half = 1 << shift - 1
    return [(u + v + half) >> shift for u, v in zip(sums, odd, strict=True)] + [(u - v + half) >> shift for u, v in zip(sums[::-1], odd[::-1], strict=True)]


def idct_islow(blocks: np.ndarray) -> np.ndarray:
    """Pixels 0..255 of dequantized blocks (n, 8, 8), by the accurate integer method: columns, then rows."""
    b = blocks.astype(np.int64)
    columns = np.stack(_one_pass([b[:, k, :] for k in range(8)], 11), axis=1)
    rows = np.stack(_one_pass([columns[:, :, k] for k in range(8)], 18), axis=2)
    return np.clip(rows + 128, 0, 255)


def idct_scaled(blocks: np.ndarray, size: int) -> np.ndarray:
    """Pixels (n, size, size) from the low frequencies only; size 1 is the DC pixel."""
    if size == 8:
        return idct_islow(blocks)
    if size == 1:
        return np.clip(((blocks[:, :1, :1].astype(np.int64) + 4) >> 3) + 128, 0, 255)
    m = np.array([[(np.sqrt(1 / size) if k == 0 else np.sqrt(2 / size)) * np.cos(np.pi * (2 * i + 1) * k / (2 * size)) for i in range(size)] for k in range(size)])
    part = blocks[:, :size, :size] * (size / 8)
    return np.clip(np.rint(np.einsum("nkl,ki,lj->nij", part, m, m)).astype(np.int64) + 128, 0, 255)


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.left = data, 0, 0, 0

    def peek16(self) -> int:
        while self.left < 16:
            self.held, self.left, self.at = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0), self.left + 8, self.at + 1
        return self.held >> self.left - 16 & 0xFFFF

    def drop(self, n: int) -> None:
        self.left -= n
        self.held &= (1 << self.left) - 1
        if self.at - self.left // 8 > len(self.data) + 2:
            raise Malformed("scan is cut off")

    def get(self, n: int) -> int:
        v = self.peek16() >> 16 - n
        self.drop(n)
        return v

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.get(n)
        return v if v >> n - 1 else v - (1 << n) + 1


def lookup(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """(length, value) by the next 16 bits; length 0 where no code begins so."""
    out, code, at = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >= 1 << length or at >= len(values):
                raise Malformed("Huffman table overflows")
            first = code << 16 - length
            out[first : first + (1 << 16 - length)] = [(length, values[at])] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def coefficients(data: bytes) -> dict:
    """Quantized blocks (natural order) of each component, with its table: {width, height, components}."""
    head = jpeg_header(data)
    sof = head["sof"]
    if sof["marker"] not in (0xC0, 0xC1) or sof["bits"] != 8:
        raise Malformed("only sequential 8-bit JPEG is supported")
    if not sof["width"] or not sof["height"]:
        raise Malformed("image without size")
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, list] = {}
    h_max, v_max = max(c["h"] for c in sof["components"]), max(c["v"] for c in sof["components"])
    across, down = -(-sof["width"] // (8 * h_max)), -(-sof["height"] // (8 * v_max))
    for c in sof["components"]:
        c["across"], c["down"] = across * c["h"], down * c["v"]
        c["blocks"] = np.zeros((c["down"], c["across"], 64), np.int64)
    interval = 0
    for marker, at, n in segments(data):
        body = data[at : at + n]
        if marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                if len(body) < size + 1:
                    raise Malformed("short quantization table")
                table = np.zeros(64, np.int64)
                table[ORDER] = np.frombuffer(body[1 : size + 1], ">u2" if size == 128 else np.uint8)
                quant[body[0] & 15], body = table, body[size + 1 :]
        elif marker == 0xC4:
            while body:
                if len(body) < 17 or len(body) < 17 + sum(body[1:17]):
                    raise Malformed("short Huffman table")
                size = sum(body[1:17])
                tables[body[0]], body = lookup(body[1:17], body[17 : 17 + size]), body[17 + size :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            from ..sources.containers import entropy_end

            _scan(data[at + n : entropy_end(data, at + n)], body, sof, tables, interval, across, down)
    for c in sof["components"]:
        if c["table"] not in quant:
            raise Malformed("a quantization table is missing")
        c["quant"] = quant[c["table"]]
    return {"width": sof["width"], "height": sof["height"], "components": sof["components"], "h_max": h_max, "v_max": v_max, "adobe": head["adobe"]}


def _scan(entropy: bytes, body: bytes, sof: dict, tables: dict, interval: int, across: int, down: int) -> None:
    if not body or len(body) < 4 + 2 * body[0]:
        raise Malformed("short scan header")
    parts = []
    for i in range(body[0]):
        ident, t = body[1 + 2 * i], body[2 + 2 * i]
        c = next((c for c in sof["components"] if c["id"] == ident), None)
        if c is None or t >> 4 not in tables or 16 + (t & 15) not in tables:
            raise Malformed("scan without component or table")
        parts.append((c, tables[t >> 4], tables[16 + (t & 15)]))
    pieces, at = [], 0
    while True:  # between restarts, without the stuffed zeros
        end = at
        while True:
            end = entropy.find(b"\xff", end)
            if end < 0 or end + 1 >= len(entropy) or entropy[end + 1] != 0:
                break
            end += 2
        pieces.append(entropy[at : end if end >= 0 else len(entropy)].replace(b"\xff\0", b"\xff"))
        if end < 0 or end + 1 >= len(entropy):
            break
        at = end + 2
    if len(parts) == 1:
        c = parts[0][0]
        h_max, v_max = max(x["h"] for x in sof["components"]), max(x["v"] for x in sof["components"])
        wide, high = -(-sof["width"] * c["h"] // (8 * h_max)), -(-sof["height"] * c["v"] // (8 * v_max))
        units = [[(0, y, x)] for y in range(high) for x in range(wide)]
    else:
        units = [[(i, y * c["v"] + j, x * c["h"] + k) for i, (c, _, _) in enumerate(parts) for j in range(c["v"]) for k in range(c["h"])] for y in range(down) for x in range(across)]
    step = interval or len(units)
    for number, first in enumerate(range(0, len(units), step)):
        if number >= len(pieces):
            raise Malformed("a restart interval is missing")
        bits, dc = Bits(pieces[number]), [0] * len(parts)
        for unit in units[first : first + step]:
            for i, y, x in unit:
                c, dc_table, ac_table = parts[i]
                length, size = dc_table[bits.peek16()]
                if not length or size > 15:
                    raise Malformed("no such code")
                bits.drop(length)
                dc[i] += bits.signed(size)
                block = c["blocks"][y, x]
                block[0], k = dc[i], 1
                while k < 64:
                    length, symbol = ac_table[bits.peek16()]
                    if not length:
                        raise Malformed("no such code")
                    bits.drop(length)
                    size, run = symbol & 15, symbol >> 4
                    if not size:
                        if run != 15:
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        raise Malformed("too many coefficients")
                    block[ZIGZAG[k]] = bits.signed(size)
                    k += 1


def _fancy_rows(p: np.ndarray) -> np.ndarray:
    """Twice as wide, by weights of 3 to 1."""
    out = np.empty((p.shape[0], 2 * p.shape[1]), np.int64)
    back, ahead = np.hstack([p[:, :1], p[:, :-1]]), np.hstack([p[:, 1:], p[:, -1:]])
    out[:, 0::2], out[:, 1::2] = (3 * p + back + 1) >> 2, (3 * p + ahead + 2) >> 2
    out[:, 0], out[:, -1] = p[:, 0], p[:, -1]
    return out


def _fancy_both(p: np.ndarray) -> np.ndarray:
    out = np.empty((2 * p.shape[0], 2 * p.shape[1]), np.int64)
    for k, near in ((0, np.vstack([p[:1], p[:-1]])), (1, np.vstack([p[1:], p[-1:]]))):
        s = 3 * p + near
        back, ahead = np.hstack([s[:, :1], s[:, :-1]]), np.hstack([s[:, 1:], s[:, -1:]])
        out[k::2, 0::2], out[k::2, 1::2] = (3 * s + back + 8) >> 4, (3 * s + ahead + 7) >> 4
        out[k::2, 0], out[k::2, -1] = (4 * s[:, 0] + 8) >> 4, (4 * s[:, -1] + 7) >> 4
    return out


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    """JPEG's fixed-point colour conversion."""
    u, v = cb - 128, cr - 128
    return [np.clip(x, 0, 255) for x in (y + ((91881 * v + 32768) >> 16), y - ((22554 * u + 46802 * v + 32768) >> 16), y + ((116130 * u + 32768) >> 16))]


def decode(data: bytes, size: int = 8, rgb: bool = True) -> list[np.ndarray]:
    """Planes of an image at size/8 (8, 4, 2 or 1); three components as RGB unless Adobe's marker says that they are RGB."""
    image = coefficients(data)
    width, height = -(-image["width"] * size // 8), -(-image["height"] * size // 8)
    planes = []
    for c in image["components"]:
        flat = (c["blocks"] * c["quant"]).clip(-32768, 32767).reshape(-1, 8, 8)
        p = idct_scaled(flat, size).reshape(c["down"], c["across"], size, size).transpose(0, 2, 1, 3).reshape(c["down"] * size, c["across"] * size)
        fx, fy = image["h_max"] // c["h"], image["v_max"] // c["v"]
        p = p[: -(-height * c["v"] // image["v_max"]), : -(-width * c["h"] // image["h_max"])]
        if (fx, fy) == (2, 1):
            p = _fancy_rows(p)
        elif (fx, fy) == (2, 2):
            p = _fancy_both(p)
        elif (fx, fy) != (1, 1):
            p = p.repeat(fy, axis=0).repeat(fx, axis=1)
        planes.append(p[:height, :width])
    if len(planes) == 3 and rgb and image["adobe"] != 0:
        return to_rgb(*planes)
    return planes


def code_lengths(counts: dict[int, int]) -> tuple[bytes, bytes]:
    """(how many codes of 1..16 bits, symbols by length) of a prefix code in which no code is all ones.

    The reserved code belongs to a symbol that is never used; counts are halved until no
    code is longer than 16 bits.
    """
    while True:
        heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, len(counts), [-1])]
        heapq.heapify(heap)
        length, serial = dict.fromkeys([*counts, -1], 0), len(heap)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, serial, x + y))
            serial += 1
        if max(length.values()) <= 16:
            break
        counts = {s: (n + 1) // 2 for s, n in counts.items()}
    symbols = sorted(counts, key=lambda s: (length[s], s))
    per = [0] * 17
    for s in symbols:
        per[length[s]] += 1
    return bytes(per[1:]), bytes(symbols)


def encode(planes: list[np.ndarray], quality: int = 90, subsample: tuple[int, int] = (1, 1), interval: int = 0) -> bytes:
    """A sequential JPEG of one grey plane or of three RGB planes, with tables made for the image."""
    height, width = planes[0].shape
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    quant = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]
    fx, fy = subsample if len(planes) == 3 else (1, 1)
    if len(planes) == 3:
        r, g, b = (p.astype(float) for p in planes)
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    across, down = -(-width // (8 * fx)), -(-height // (8 * fy))
    parts = []
    for i, p in enumerate(planes):
        h, v = (fx, fy) if i == 0 else (1, 1)
        full = np.pad(p.astype(float), ((0, down * 8 * fy - height), (0, across * 8 * fx - width)), mode="edge")
        if i:
            full = full.reshape(down * 8, fy, across * 8, fx).mean(axis=(1, 3))
        cells = full.reshape(down * v, 8, across * h, 8).transpose(0, 2, 1, 3) - 128
        c = np.einsum("ki,yxij,lj->yxkl", BASIS, cells, BASIS).reshape(down * v, across * h, 64)
        parts.append((h, v, np.rint(c / quant[min(i, 1)]).astype(int)[:, :, ORDER]))
    symbols: list[tuple[int, int, int, int]] = []  # (table, symbol, bits, value); table -1: restart
    dc = [0] * len(parts)
    for number in range(across * down):
        if interval and number and number % interval == 0:
            symbols.append((-1, 0, 0, 0))
            dc = [0] * len(parts)
        y, x = divmod(number, across)
        for i, (h, v, c) in enumerate(parts):
            for j in range(v):
                for k in range(h):
                    block = c[y * v + j, x * h + k].tolist()
                    _block_symbols(symbols, block, dc[i], min(i, 1))
                    dc[i] = block[0]
    out = b"\xff\xd8"

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    kinds = range(1 if len(parts) == 1 else 2)
    for t in kinds:
        out += segment(0xDB, bytes([t]) + bytes(quant[t][ORDER].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, min(i, 1)]) for i, (h, v, _) in enumerate(parts)))
    codes: dict[int, dict[int, tuple[int, int]]] = {}
    for t in (k + a for k in kinds for a in (0, 16)):
        counts: dict[int, int] = {}
        for table, s, _, _ in symbols:
            if table == t:
                counts[s] = counts.get(s, 0) + 1
        per, values = code_lengths(counts or {0: 1})
        out += segment(0xC4, bytes([t]) + per + values)
        code, at, codes[t] = 0, 0, {}
        for length, n in enumerate(per, 1):
            for _ in range(n):
                codes[t][values[at]] = (code, length)
                code, at = code + 1, at + 1
            code <<= 1
    if interval:
        out += segment(0xDD, struct.pack(">H", interval))
    out += segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in range(len(parts))) + bytes([0, 63, 0]))
    held, bits, body, restart = 0, 0, bytearray(), 0

    def close() -> None:
        nonlocal held, bits
        pad = -bits % 8
        body.extend(((held << pad) | (1 << pad) - 1).to_bytes((bits + pad) // 8, "big").replace(b"\xff", b"\xff\0"))
        held = bits = 0

    for table, s, n, value in symbols:
        if table < 0:
            close()
            body += bytes([0xFF, 0xD0 + restart % 8])
            restart += 1
            continue
        code, length = codes[table][s]
        held, bits = held << length + n | code << n | value, bits + length + n
        if bits > 4096:
            rest = bits % 8
            body += (held >> rest).to_bytes(bits // 8, "big").replace(b"\xff", b"\xff\0")
            held, bits = held & (1 << rest) - 1, rest
    close()
    return out + bytes(body) + b"\xff\xd9"


def _block_symbols(out: list, block: list[int], before: int, table: int) -> None:
    def put(t: int, run: int, v: int) -> None:
        n = abs(v).bit_length()
        out.append((t, run << 4 | n, n, v if v >= 0 else v + (1 << n) - 1))

    put(table, 0, block[0] - before)
    run = 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((16 + table, 0xF0, 0, 0))
            run -= 16
        put(16 + table, run, v)
        run = 0
    if run:
        out.append((16 + table, 0, 0, 0))
