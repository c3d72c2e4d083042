"""Arithmetic coder, code-block passes, tag trees and packet bits of JPEG 2000 Part 1."""

from __future__ import annotations

import numpy as np

# fixed values: probability states (Qe, next if more probable, next if less probable, switch)
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0))
RUN, UNIFORM, CONTEXTS = 17, 18, 19


def fresh_contexts() -> tuple[list[int], list[int]]:
    index = [0] * CONTEXTS
    index[0], index[RUN], index[UNIFORM] = 4, 3, 46
    return index, [0] * CONTEXTS


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.index, self.mps = fresh_contexts()
        self.c = (data[0] if data else 0xFF) << 16
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        data, at = self.data, self.at
        here = data[at] if at < len(data) else 0xFF
        ahead = data[at + 1] if at + 1 < len(data) else 0xFF
        if here == 0xFF:
            if ahead > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += ahead << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += ahead << 8
            self.ct = 8

    def bit(self, cx: int) -> int:
        qe, up, down, switch = STATES[self.index[cx]]
        d = self.mps[cx]
        self.a -= qe
        if self.c >> 16 < qe:
            less, self.a, small = self.a >= qe, qe, True
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return d
            less, small = self.a < qe, False
        if less:
            if switch:
                self.mps[cx] = 1 - d
            d, self.index[cx] = 1 - d, down
        else:
            self.index[cx] = up
        while True:
            if self.ct == 0:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
            if self.a & 0x8000:
                return d


class Encoder:
    def __init__(self) -> None:
        self.index, self.mps = fresh_contexts()
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray(1)  # out[0] stands before the first byte

    def bit(self, d: int, cx: int) -> None:
        qe, up, down, switch = STATES[self.index[cx]]
        self.a -= qe
        if d == self.mps[cx]:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            self.index[cx] = up
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            if switch:
                self.mps[cx] = 1 - self.mps[cx]
            self.index[cx] = down
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if self.ct == 0:
                self._byte()
            if self.a & 0x8000:
                return

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append((self.c >> 20) & 0xFF)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append((self.c >> 19) & 0xFF)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def flush(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        return bytes(self.out[1:-1] if self.out[-1] == 0xFF else self.out[1:])


def _zero_contexts(band: str) -> list[int]:
    """Labels by (h, v, d) neighbours, as h * 15 + v * 5 + d."""
    out = []
    for h in range(3):
        for v in range(3):
            for d in range(5):
                if band == "HH":
                    s = h + v
                    out.append(8 if d >= 3 else (7 if s else 6) if d == 2 else 3 + min(s, 2) if d == 1 else min(s, 2))
                else:
                    a, b = (v, h) if band == "HL" else (h, v)
                    out.append(8 if a == 2 else (7 if b else 6 if d else 5) if a == 1 else 2 + b if b else min(d, 2))
    return out


ZERO = {band: _zero_contexts(band) for band in ("LL", "LH", "HL", "HH")}
#: (context, flip) by the signs of the neighbours across and down.
SIGN = {(1, 1): (13, 0), (1, 0): (12, 0), (1, -1): (11, 0), (0, 1): (10, 0), (0, 0): (9, 0), (0, -1): (10, 1), (-1, 1): (11, 1), (-1, 0): (12, 1), (-1, -1): (13, 1)}


class Block:
    """The state of a code-block: signs (+1, -1, 0 if not yet significant) with a border, magnitudes, and what was refined."""

    def __init__(self, width: int, height: int, band: str) -> None:
        self.w, self.h, self.stride = width, height, width + 2
        self.sign = [0] * (self.stride * (height + 2))
        self.value = [0] * len(self.sign)
        self.refined = bytearray(len(self.sign))
        self.seen = bytearray(len(self.sign))
        self.zero = ZERO[band]

    def around(self, i: int) -> tuple[int, int, int]:
        s, t = self.sign, self.stride
        return (s[i - 1] != 0) + (s[i + 1] != 0), (s[i - t] != 0) + (s[i + t] != 0), (s[i - t - 1] != 0) + (s[i - t + 1] != 0) + (s[i + t - 1] != 0) + (s[i + t + 1] != 0)

    def sign_context(self, i: int) -> tuple[int, int]:
        s, t = self.sign, self.stride
        return SIGN[max(-1, min(1, s[i - 1] + s[i + 1])), max(-1, min(1, s[i - t] + s[i + t]))]

    def walk(self):
        """Indices in stripes of four rows, down each column."""
        for y in range(0, self.h, 4):
            for x in range(self.w):
                yield [(y + k + 1) * self.stride + x + 1 for k in range(min(4, self.h - y))]

    def passes(self, planes: int, code) -> None:
        """Runs the three passes of each plane; ``code(kind, ...)`` moves bits, and ends the block by raising StopIteration."""
        for plane in range(planes - 1, -1, -1):
            if plane != planes - 1:
                code.begin()
                self._propagate(plane, code)
                code.begin()
                self._refine(plane, code)
            code.begin()
            self._cleanup(plane, code)
            self.seen = bytearray(len(self.seen))

    def _found(self, i: int, plane: int, code) -> None:
        cx, flip = self.sign_context(i)
        negative = code.move(i, "sign", cx, flip, plane)
        self.sign[i] = -1 if negative else 1
        self.value[i] |= 1 << plane

    def _propagate(self, plane: int, code) -> None:
        for column in self.walk():
            for i in column:
                if not self.sign[i]:
                    h, v, d = self.around(i)
                    if h or v or d:
                        self.seen[i] = 1
                        if code.move(i, "bit", self.zero[h * 15 + v * 5 + d], 0, plane):
                            self._found(i, plane, code)

    def _refine(self, plane: int, code) -> None:
        for column in self.walk():
            for i in column:
                if self.sign[i] and not self.seen[i]:
                    cx = 16 if self.refined[i] else 15 if any(self.around(i)) else 14
                    self.refined[i] = 1
                    if code.move(i, "bit", cx, 0, plane):
                        self.value[i] |= 1 << plane

    def _cleanup(self, plane: int, code) -> None:
        for column in self.walk():
            start = 0
            if len(column) == 4 and not any(self.sign[i] or self.seen[i] or any(self.around(i)) for i in column):
                start = code.run(column, plane)
                if start == 4:
                    continue
                self._found(column[start], plane, code)
                start += 1
            for i in column[start:]:
                if not self.sign[i] and not self.seen[i]:
                    h, v, d = self.around(i)
                    if code.move(i, "bit", self.zero[h * 15 + v * 5 + d], 0, plane):
                        self._found(i, plane, code)


class Reading:
    def __init__(self, data: bytes, passes: int) -> None:
        self.mq, self.left = Decoder(data), passes

    def begin(self) -> None:
        if not self.left:
            raise StopIteration
        self.left -= 1

    def move(self, i: int, kind: str, cx: int, flip: int, plane: int) -> int:
        return self.mq.bit(cx) ^ flip

    def run(self, column: list[int], plane: int) -> int:
        if not self.mq.bit(RUN):
            return 4
        return self.mq.bit(UNIFORM) << 1 | self.mq.bit(UNIFORM)


class Writing:
    def __init__(self, magnitude: list[int], negative: list[int]) -> None:
        self.mq, self.count, self.magnitude, self.negative = Encoder(), 0, magnitude, negative

    def begin(self) -> None:
        self.count += 1

    def move(self, i: int, kind: str, cx: int, flip: int, plane: int) -> int:
        bit = self.negative[i] if kind == "sign" else self.magnitude[i] >> plane & 1
        self.mq.bit(bit ^ flip, cx)
        return bit

    def run(self, column: list[int], plane: int) -> int:
        first = next((k for k, i in enumerate(column) if self.magnitude[i] >> plane & 1), 4)
        self.mq.bit(int(first < 4), RUN)
        if first < 4:
            self.mq.bit(first >> 1, UNIFORM)
            self.mq.bit(first & 1, UNIFORM)
        return first


def encode_block(values: np.ndarray, band: str) -> tuple[bytes, int, int]:
    """(bytes, passes, planes) of integers."""
    h, w = values.shape
    block = Block(w, h, band)
    held = np.zeros((h + 2, w + 2), np.int64)
    held[1:-1, 1:-1] = values
    magnitude = np.abs(held).ravel().tolist()
    planes = max(magnitude).bit_length()
    if not planes:
        return b"", 0, 0
    code = Writing(magnitude, (held < 0).astype(int).ravel().tolist())
    block.passes(planes, code)
    return code.mq.flush(), code.count, planes


def decode_block(data: bytes, passes: int, planes: int, width: int, height: int, band: str) -> tuple[np.ndarray, int]:
    """Integers, and how many low planes were not decoded."""
    block = Block(width, height, band)
    code = Reading(data, passes)
    try:
        block.passes(planes, code)
    except StopIteration:
        pass
    missing = max(0, planes - (passes + 2) // 3)
    value = np.array(block.value, np.int64).reshape(height + 2, width + 2)[1:-1, 1:-1]
    sign = np.array(block.sign, np.int64).reshape(height + 2, width + 2)[1:-1, 1:-1]
    return value * sign, missing


class BitWriter:
    """Bits of packet headers: after a byte of 255 comes a byte of seven bits."""

    def __init__(self) -> None:
        self.out, self.held, self.free = bytearray(), 0, 8

    def put(self, value: int, count: int = 1) -> None:
        for i in range(count - 1, -1, -1):
            self.free -= 1
            self.held |= (value >> i & 1) << self.free
            if not self.free:
                self.out.append(self.held)
                self.free, self.held = (7 if self.held == 0xFF else 8), 0

    def done(self) -> bytes:
        if self.free < 8 and not (self.free == 7 and self.out[-1:] == b"\xff"):
            self.out.append(self.held)
            if self.held == 0xFF:
                self.out.append(0)
        elif self.out[-1:] == b"\xff":
            self.out.append(0)
        return bytes(self.out)


class BitReader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at, self.left, self.last = data, at, 0, 0

    def get(self, count: int = 1) -> int:
        value = 0
        for _ in range(count):
            if not self.left:
                self.left = 7 if self.last == 0xFF else 8
                if self.at >= len(self.data):
                    raise ValueError("packet header is cut off")
                self.last = self.data[self.at]
                self.at += 1
            self.left -= 1
            value = value << 1 | (self.last >> self.left & 1)
        return value

    def done(self) -> int:
        return self.at + (self.last == 0xFF)


class TagTree:
    """Least values of ever larger squares; a leaf is told apart from a threshold by walking down from the root."""

    def __init__(self, width: int, height: int, values: list[int] | None = None) -> None:
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1):
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]
        self.value: list[list[int]] = [values] if values is not None else []
        for (w, h), (pw, ph) in zip(self.sizes, self.sizes[1:], strict=False) if values is not None else ():
            below = self.value[-1]
            self.value.append([min(below[y * w + x] for y in range(2 * j, min(2 * j + 2, h)) for x in range(2 * i, min(2 * i + 2, w))) for j in range(ph) for i in range(pw)])

    def visit(self, x: int, y: int, threshold: int, bits: BitReader | BitWriter) -> bool:
        """Whether the leaf's value is below the threshold; moves the bits that tell it."""
        low, node = 0, 0
        for level in range(len(self.sizes) - 1, -1, -1):
            node = (y >> level) * self.sizes[level][0] + (x >> level)
            low = max(low, self.low[level][node])
            while low < threshold and not self.known[level][node]:
                if isinstance(bits, BitWriter):
                    hit = self.value[level][node] <= low
                    bits.put(int(hit))
                else:
                    hit = bool(bits.get())
                if hit:
                    self.known[level][node] = True
                else:
                    low += 1
            self.low[level][node] = low
        return self.known[0][node] and low < threshold

    def leaf(self, x: int, y: int) -> int:
        return self.low[0][y * self.sizes[0][0] + x]


def put_passes(bits: BitWriter, n: int) -> None:
    if n == 1:
        bits.put(0)
    elif n == 2:
        bits.put(2, 2)
    elif n <= 5:
        bits.put(0b11 << 2 | n - 3, 4)
    elif n <= 36:
        bits.put(0b1111 << 5 | n - 6, 9)
    else:
        bits.put(0b111111111 << 7 | n - 37, 16)


def get_passes(bits: BitReader) -> int:
    for count, least, stop in ((1, 1, 1), (1, 2, 1), (2, 3, 3), (5, 6, 31)):
        n = bits.get(count)
        if n < stop:
            return least + n
    return 37 + bits.get(7)
