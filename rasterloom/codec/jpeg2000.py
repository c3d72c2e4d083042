"""JPEG 2000 Part 1: whole images to codestreams and back, with regions and reduced resolutions."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.wavelet import ALPHA, BETA, DELTA, GAMMA, KAPPA
from ..sources.containers import JP2_SIGNATURE, Malformed, container, main_header
from . import blocks

ORDERS = ("lrcp", "rlcp", "rpcl", "pcrl", "cprl")
ICT = np.array([[0.299, 0.587, 0.114], [-0.16875, -0.33126, 0.5], [0.5, -0.41869, -0.08131]])
ICT_BACK = np.array([[1.0, 0.0, 1.402], [1.0, -0.34413, -0.71414], [1.0, 1.772, 0.0]])
MAX_SIDE, MAX_SAMPLES = 60000, 1 << 28


def up(a: int, b: int) -> int:
    return -(-a // b)


def _lift(x: np.ndarray, start: int, step, odd: int) -> None:
    """Changes the samples of one parity (of start + i) by step(left, right); ends are mirrored."""
    n = len(x)
    own = np.arange((odd - start) % 2, n, 2)
    left, right = np.abs(own - 1), own + 1
    right = np.where(right < n, right, 2 * (n - 1) - right)
    if n > 1:
        x[own] += step(x[left], x[right])


def analyse(x: np.ndarray, start: int, reversible: bool) -> tuple[np.ndarray, np.ndarray]:
    """Low and high part along the first axis, of samples at start, start + 1, .."""
    x = x.copy()
    if len(x) > 1:
        if reversible:
            _lift(x, start, lambda a, b: -((a + b) >> 1), 1)
            _lift(x, start, lambda a, b: (a + b + 2) >> 2, 0)
        else:
            for i, c in enumerate((ALPHA, BETA, GAMMA, DELTA)):
                _lift(x, start, lambda a, b, c=c: c * (a + b), 1 - i % 2)
    elif start % 2:
        x = x * 2
    low, high = x[start % 2 :: 2], x[1 - start % 2 :: 2]
    return (low, high) if reversible or len(x) < 2 else (low / KAPPA, high * KAPPA)


def synthesise(low: np.ndarray, high: np.ndarray, start: int, reversible: bool) -> np.ndarray:
    n = len(low) + len(high)
    x = np.empty((n, *low.shape[1:]), np.int64 if reversible else np.float64)
    scaled = not reversible and n > 1
    x[start % 2 :: 2], x[1 - start % 2 :: 2] = (low * KAPPA, high / KAPPA) if scaled else (low, high)
    if n > 1:
        if reversible:
            _lift(x, start, lambda a, b: -((a + b + 2) >> 2), 0)
            _lift(x, start, lambda a, b: (a + b) >> 1, 1)
        else:
            for i, c in enumerate((DELTA, GAMMA, BETA, ALPHA)):
                _lift(x, start, lambda a, b, c=c: -c * (a + b), i % 2)
    elif start % 2:
        x = x // 2 if reversible else x / 2
    return x


@dataclass
class CodeBlock:
    band: "Band"
    x0: int
    y0: int
    x1: int
    y1: int
    data: bytes = b""
    passes: int = 0
    planes: int = 0
    lblock: int = 3
    included: bool = False


@dataclass
class Band:
    name: str
    x0: int
    y0: int
    x1: int
    y1: int
    exponent: int
    delta: float
    bits: int
    values: np.ndarray | None = None


@dataclass
class Precinct:
    ref_x: int
    ref_y: int
    cells: list = field(default_factory=list)  # (across, down, blocks) of each band
    trees: list = field(default_factory=list)


@dataclass
class Resolution:
    x0: int
    y0: int
    x1: int
    y1: int
    bands: list[Band]
    precincts: list[Precinct]


def layout(head: dict, tile: int, comp: int) -> tuple[tuple[int, int, int, int], list[Resolution]]:
    """A tile-component's rectangle, resolutions, bands, precincts and code-blocks."""
    siz, style, q = head["siz"], head["styles"][comp], head["quantizers"][comp]
    part = siz["components"][comp]
    across = up(siz["x1"] - siz["tile_x"], siz["tile_w"])
    tx, ty = siz["tile_x"] + tile % across * siz["tile_w"], siz["tile_y"] + tile // across * siz["tile_h"]
    t0x, t0y = max(tx, siz["x0"]), max(ty, siz["y0"])
    rect = [up(t0x, part["xr"]), up(t0y, part["yr"]), up(min(tx + siz["tile_w"], siz["x1"]), part["xr"]), up(min(ty + siz["tile_h"], siz["y1"]), part["yr"])]
    nl, out = style["levels"], []
    for r in range(nl + 1):
        d = 1 << nl - r
        rx0, ry0, rx1, ry1 = (up(v, d) for v in rect)
        level = nl if r == 0 else nl - r + 1
        bands = []
        for b, name in enumerate(["LL"] if r == 0 else ["HL", "LH", "HH"]):
            ox, oy = (1 << level - 1 if level and name in two else 0 for two in (("HL", "HH"), ("LH", "HH")))
            place = [up(max(v - o, 0), 1 << level) for v, o in zip(rect, (ox, oy, ox, oy), strict=True)]
            k = 0 if r == 0 else 3 * (r - 1) + 1 + b
            gain = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}[name]
            if q["kind"] == 1:
                e, m = q["steps"][0][0] - (0 if r == 0 else r - 1), q["steps"][0][1]
            else:
                if k >= len(q["steps"]):
                    raise Malformed("a quantizer step is missing")
                e, m = q["steps"][k]
            delta = 1.0 if q["kind"] == 0 else 2.0 ** (part["bits"] + gain - e) * (1 + m / 2048)
            bands.append(Band(name, *place, e, delta, q["guard"] + e - 1))
        ppx, ppy = style["ppx"][r], style["ppy"][r]
        if r and not (ppx and ppy):
            raise Malformed("precinct size")
        px = up(rx1, 1 << ppx) - (rx0 >> ppx) if rx1 > rx0 else 0
        py = up(ry1, 1 << ppy) - (ry0 >> ppy) if ry1 > ry0 else 0
        if px * py > 1 << 16:
            raise Malformed("too many precincts")
        bw, bh = min(style["xcb"], ppx - bool(r)), min(style["ycb"], ppy - bool(r))
        precincts = []
        for j in range(py):
            for i in range(px):
                ref = []
                for at, low, t0, step, pp in ((i, rx0, t0x, part["xr"], ppx), (j, ry0, t0y, part["yr"], ppy)):
                    stride = step << pp + nl - r
                    ref.append(t0 if at == 0 and (low % (1 << pp) or t0 % stride == 0) else up(t0, stride) * stride if at == 0 else ((low >> pp) + at) * stride)
                p = Precinct(*ref)
                for band in bands:
                    ex, ey = ppx - bool(r), ppy - bool(r)
                    fx, fy = (rx0 >> ppx) + i, (ry0 >> ppy) + j
                    x0, x1 = max(band.x0, fx << ex), min(band.x1, fx + 1 << ex)
                    y0, y1 = max(band.y0, fy << ey), min(band.y1, fy + 1 << ey)
                    if x1 <= x0 or y1 <= y0:
                        p.cells.append((0, 0, []))
                        continue
                    cx, cy = range(x0 >> bw, up(x1, 1 << bw)), range(y0 >> bh, up(y1, 1 << bh))
                    p.cells.append((len(cx), len(cy), [CodeBlock(band, max(x0, c << bw), max(y0, k << bh), min(x1, c + 1 << bw), min(y1, k + 1 << bh)) for k in cy for c in cx]))
                precincts.append(p)
        out.append(Resolution(rx0, ry0, rx1, ry1, bands, precincts))
    return tuple(rect), out


def packet_order(head: dict, parts: list[list[Resolution]], changes: list[dict]) -> list[tuple[int, int, int, int]]:
    """(layer, resolution, component, precinct) in the codestream's order; each once, where the first change has it."""
    layers = head["cod"]["layers"]
    every = [(c, r, k, p.ref_x, p.ref_y) for c, rs in enumerate(parts) for r, res in enumerate(rs) for k, p in enumerate(res.precincts)]
    volumes = changes or [{"res0": 0, "comp0": 0, "layer1": layers, "res1": 33, "comp1": len(parts), "order": head["cod"]["order"]}]
    seen, out = set(), []
    for v in volumes:
        chosen = [(la, *e) for e in every if v["comp0"] <= e[0] < (v["comp1"] or 256) and v["res0"] <= e[1] < v["res1"] for la in range(min(v["layer1"], layers))]
        keys = {
            0: lambda t: (t[0], t[2], t[1], t[3]), 1: lambda t: (t[2], t[0], t[1], t[3]), 2: lambda t: (t[2], t[5], t[4], t[1], t[3], t[0]),
            3: lambda t: (t[5], t[4], t[1], t[2], t[3], t[0]), 4: lambda t: (t[1], t[5], t[4], t[2], t[3], t[0])}
        if v["order"] not in keys:
            raise Malformed("unknown progression")
        for la, c, r, k, _, _ in sorted(chosen, key=keys[v["order"]]):
            if (la, r, c, k) not in seen:
                seen.add((la, r, c, k))
                out.append((la, r, c, k))
    return out


def read_packet(data: bytes, at: int, precinct: Precinct, layer: int, flags: int, style: int) -> int:
    if data[at : at + 2] == b"\xff\x91":
        at += 6
    bits = blocks.BitReader(data, at)
    if not precinct.trees:
        precinct.trees = [(blocks.TagTree(w, h), blocks.TagTree(w, h)) if w else None for w, h, _ in precinct.cells]
    bodies = []
    if bits.get():
        for (w, _, cells), trees in zip(precinct.cells, precinct.trees, strict=True):
            for i, cb in enumerate(cells):
                x, y = i % w, i // w
                first = not cb.included
                if not (trees[0].visit(x, y, layer + 1, bits) if first else bits.get()):
                    continue
                if first:
                    cb.included = True
                    zero = 1
                    while not trees[1].visit(x, y, zero, bits):
                        zero += 1
                        if zero > 80:
                            raise Malformed("zero planes")
                    cb.planes = cb.band.bits - (zero - 1)
                    if cb.planes < 0:
                        raise Malformed("zero planes")
                n = blocks.get_passes(bits)
                while bits.get():
                    cb.lblock += 1
                bodies.append((cb, n, bits.get(cb.lblock + n.bit_length() - 1)))
    at = bits.done()
    if data[at : at + 2] == b"\xff\x92":
        at += 2
    for cb, n, size in bodies:
        if at + size > len(data):
            raise Malformed("packet is cut off")
        cb.data += data[at : at + size]
        cb.passes += n
        at += size
    return at


def write_packet(precinct: Precinct) -> bytes:
    bits = blocks.BitWriter()
    body = b""
    bits.put(1)
    for w, h, cells in precinct.cells:
        if not w:
            continue
        inclusion = blocks.TagTree(w, h, [0 if cb.passes else 1 for cb in cells])
        zero = blocks.TagTree(w, h, [cb.band.bits - cb.planes for cb in cells])
        for i, cb in enumerate(cells):
            x, y = i % w, i // w
            inclusion.visit(x, y, 1, bits)
            if not cb.passes:
                continue
            for t in range(1, cb.band.bits - cb.planes + 2):
                zero.visit(x, y, t, bits)
            blocks.put_passes(bits, cb.passes)
            extra = cb.passes.bit_length() - 1
            grow = max(0, len(cb.data).bit_length() - 3 - extra)
            bits.put((1 << grow + 1) - 2, grow + 1)
            bits.put(len(cb.data), 3 + grow + extra)
            body += cb.data
    return bits.done() + body


def encode(planes: list[np.ndarray], bits: int = 8, signed: bool = False, levels: int = 3, reversible: bool = True, order: str = "lrcp", block: int = 6, tile: tuple[int, int] | None = None, step: float = 1 / 64, precinct: int = 15) -> bytes:
    """A codestream of planes of equal size, one quality layer; three or more planes are decorrelated."""
    h, w = planes[0].shape
    tw, th = tile or (w, h)
    n, mct, guard = len(planes), len(planes) >= 3, 2
    siz = struct.pack(">HIIIIIIIIH", 0, w, h, 0, 0, tw, th, 0, 0, n) + bytes([bits - 1 | (128 if signed else 0), 1, 1]) * n
    sizes = bytes([precinct | precinct << 4] * (levels + 1)) if precinct < 15 else b""
    cod = struct.pack(">BBHB", int(bool(sizes)), ORDERS.index(order), 1, int(mct)) + bytes([levels, block - 2, block - 2, 0, int(reversible)]) + sizes
    gains = [0] + [1, 1, 2] * levels
    if reversible:
        qcd = bytes([guard << 5]) + bytes([(bits + g + int(mct)) << 3 for g in gains])
    else:
        steps = []
        for g in gains:
            range_bits = bits + g
            e = range_bits - int(np.floor(np.log2(step * (1 << bits))))
            m = int(round((step * (1 << bits) / 2.0 ** (range_bits - e) - 1) * 2048))
            steps.append(struct.pack(">H", min(e, 31) << 11 | min(m, 2047)))
        qcd = bytes([guard << 5 | 2]) + b"".join(steps)
    out = b"\xff\x4f" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(p) + 2) + p for m, p in ((0x51, siz), (0x52, cod), (0x5C, qcd)))
    head = main_header(out + b"\xff\xd9")
    shift = 0 if signed else 1 << bits - 1
    for t in range(up(w, tw) * up(h, th)):
        parts, samples = [], []
        for c in range(n):
            rect, res = layout(head, t, c)
            parts.append(res)
            samples.append(planes[c][rect[1] : rect[3], rect[0] : rect[2]].astype(np.int64) - shift)
        if mct:
            r, g, b = samples[:3]
            samples[:3] = [(r + 2 * g + b) >> 2, b - g, r - g] if reversible else list(np.tensordot(ICT, np.stack([r, g, b]).astype(float), 1))
        for res, x in zip(parts, samples, strict=True):
            low = x if reversible else x.astype(np.float64)
            for r in range(levels, 0, -1):
                y0, x0 = res[r].y0, res[r].x0
                top, bottom = analyse(low, y0, reversible)
                (ll, hl), (lh, hh) = ([v.T for v in analyse(part.T, x0, reversible)] for part in (top, bottom))
                low = ll
                for band, v in zip(res[r].bands, (hl, lh, hh), strict=True):
                    band.values = v
            res[0].bands[0].values = low
            for level in res:
                for p in level.precincts:
                    for _, _, cells in p.cells:
                        for cb in cells:
                            v = cb.band.values[cb.y0 - cb.band.y0 : cb.y1 - cb.band.y0, cb.x0 - cb.band.x0 : cb.x1 - cb.band.x0]
                            if not reversible:
                                v = (np.sign(v) * np.floor(np.abs(v) / cb.band.delta)).astype(np.int64)
                            cb.data, cb.passes, cb.planes = blocks.encode_block(v, cb.band.name)
                            if cb.planes > cb.band.bits:
                                raise ValueError("coefficients need more planes than the guard bits give")
        body = b"".join(write_packet(parts[c][r].precincts[k]) for _, r, c, k in packet_order(head, parts, []))
        out += b"\xff\x90" + struct.pack(">HHIBB", 10, t, len(body) + 14, 0, 1) + b"\xff\x93" + body
    return out + b"\xff\xd9"


def decode(data: bytes, reduce: int = 0, region: tuple[int, int, int, int] | None = None) -> dict:
    """Component planes (and their depths) of a codestream or JP2 file, at 1/2**reduce; only tiles that meet the region are decoded.

    The region is (x, y, width, height) in the full image; the planes cover it, rounded
    outwards at reduced size.
    """
    offset = container(data)["offset"] if data[:12] == JP2_SIGNATURE else 0
    head = main_header(data, offset)
    siz = head["siz"]
    if "CAP" in head["markers"] or any(s["style"] & 0x40 for s in head["styles"]):
        raise Malformed("high-throughput blocks are not supported")
    if any(s["style"] for s in head["styles"]) or head["rgn"] or {"PPM", "PPT"} & set(head["markers"]):
        raise Malformed("this coding style is not supported")
    if any(reduce > s["levels"] for s in head["styles"]):
        raise Malformed("fewer levels than asked to leave out")
    w, h = siz["x1"] - siz["x0"], siz["y1"] - siz["y0"]
    if max(w, h) > MAX_SIDE or w * h * len(siz["components"]) > MAX_SAMPLES:
        raise Malformed("image is too large")
    if region is None:
        region = (0, 0, w, h)
    x, y, rw, rh = region
    if rw <= 0 or rh <= 0 or x < 0 or y < 0 or x + rw > w or y + rh > h:
        raise Malformed("region is empty or leaves the image")
    scale = 1 << reduce
    area = (siz["x0"] + x, siz["y0"] + y, siz["x0"] + x + rw, siz["y0"] + y + rh)
    boxes = [[area[0] // p["xr"] // scale, area[1] // p["yr"] // scale, up(up(area[2], p["xr"]), scale), up(up(area[3], p["yr"]), scale)] for p in siz["components"]]
    exact = [np.zeros((b[3] - b[1], b[2] - b[0]), np.int64) for b in boxes]
    bodies: dict[int, bytes] = {}
    changes: dict[int, list] = {}
    for part in head["parts"]:
        if "offset" not in part:
            raise Malformed("tile-part without data")
        bodies[part["tile"]] = bodies.get(part["tile"], b"") + data[part["offset"] : part["offset"] + part["size"]]
        if any(name in ("COD", "COC", "QCD", "QCC", "RGN") for name, _ in part["own"]):
            raise Malformed("settings of single tiles are not supported")
        changes.setdefault(part["tile"], list(head["poc"]))
    for t, body in sorted(bodies.items()):
        parts, rects = [], []
        for c in range(len(siz["components"])):
            rect, res = layout(head, t, c)
            rects.append(rect)
            parts.append(res)
        p0 = siz["components"][0]
        if rects[0][2] * p0["xr"] <= area[0] or rects[0][0] * p0["xr"] >= area[2] or rects[0][3] * p0["yr"] <= area[1] or rects[0][1] * p0["yr"] >= area[3]:
            continue
        at = 0
        for layer, r, c, k in packet_order(head, parts, changes[t]):
            if at >= len(body):
                break
            at = read_packet(body, at, parts[c][r].precincts[k], layer, head["cod"]["flags"], 0)
        samples = [_component(res, style, reduce) for res, style in zip(parts, head["styles"], strict=True)]
        if head["cod"]["mct"]:
            if len(samples) < 3 or len({s.shape for s in samples[:3]}) > 1:
                raise Malformed("components of different sizes can't be decorrelated")
            a, b, c = samples[:3]
            if head["styles"][0]["reversible"]:
                g = a - ((b + c) >> 2)
                samples[:3] = [c + g, g, b + g]
            else:
                samples[:3] = list(np.tensordot(ICT_BACK, np.stack([a, b, c]).astype(float), 1))
        for c, (v, box, part) in enumerate(zip(samples, boxes, siz["components"], strict=True)):
            low = 0 if not part["signed"] else -(1 << part["bits"] - 1)
            v = np.rint(v).astype(np.int64) + (0 if part["signed"] else 1 << part["bits"] - 1)
            v = np.clip(v, low, low + (1 << part["bits"]) - 1)
            res = parts[c][len(parts[c]) - 1 - reduce]
            x0, y0, x1, y1 = max(res.x0, box[0]), max(res.y0, box[1]), min(res.x1, box[2]), min(res.y1, box[3])
            if x1 > x0 and y1 > y0:
                exact[c][y0 - box[1] : y1 - box[1], x0 - box[0] : x1 - box[0]] = v[y0 - res.y0 : y1 - res.y0, x0 - res.x0 : x1 - res.x0]
    return {"planes": exact, "components": siz["components"], "reversible": head["styles"][0]["reversible"]}


def _component(res: list[Resolution], style: dict, reduce: int) -> np.ndarray:
    reversible = style["reversible"]
    kept = res[: len(res) - reduce]
    for level in kept:
        for band in level.bands:
            band.values = np.zeros((band.y1 - band.y0, band.x1 - band.x0), np.int64 if reversible else np.float64)
        for p in level.precincts:
            for _, _, cells in p.cells:
                for cb in cells:
                    if not cb.passes:
                        continue
                    v, missing = blocks.decode_block(cb.data, cb.passes, cb.planes, cb.x1 - cb.x0, cb.y1 - cb.y0, cb.band.name)
                    if missing or not reversible:
                        half = (1 << missing) / 2
                        v = np.where(v != 0, v + np.sign(v) * (half if not reversible else int(half)), 0)
                    if not reversible:
                        v = v * cb.band.delta
                    cb.band.values[cb.y0 - cb.band.y0 : cb.y1 - cb.band.y0, cb.x0 - cb.band.x0 : cb.x1 - cb.band.x0] = v
    low = kept[0].bands[0].values
    for level in kept[1:]:
        hl, lh, hh = (b.values for b in level.bands)
        top, bottom = synthesise(low.T, hl.T, level.x0, reversible).T, synthesise(lh.T, hh.T, level.x0, reversible).T
        low = synthesise(top, bottom, level.y0, reversible)
    return low
