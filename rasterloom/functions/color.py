"""Colour transforms; reversible and JPEG ones are exact on bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import big, clamp, shr

# fixed values: forward and inverse irreversible colour transform
ICT_FORWARD = ((0.299, 0.587, 0.114), (-0.16875, -0.33126, 0.5), (0.5, -0.41869, -0.08131))
ICT_INVERSE = ((1.0, 0.0, 1.402), (1.0, -0.34413, -0.71414), (1.0, 1.772, 0.0))
# fixed values: JPEG's 1.40200, 0.34414, 0.71414 and 1.77200 with 16 fraction bits
FIX_R_CR, FIX_G_CB, FIX_G_CR, FIX_B_CB, HALF = 91881, 22554, 46802, 116130, 32768


def forward_rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return shr(r + 2 * g + b, 2), b - g, r - g


def inverse_rct(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = y - shr(cb + cr, 2)
    return cr + g, g, cb + g


def _matrix(rows, values) -> tuple[Column, ...]:
    return tuple(sum((v.cast("double") * F.lit(c) for c, v in zip(row[1:], values[1:], strict=True)), values[0].cast("double") * F.lit(row[0])) for row in rows)


def forward_ict(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return _matrix(ICT_FORWARD, (r, g, b))


def inverse_ict(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    return _matrix(ICT_INVERSE, (y, cb, cr))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, bits: int = 8) -> tuple[Column, Column, Column]:
    """JPEG's fixed-point conversion at 8, 12 or 16 bits: the green term is the shifted sum."""
    centre, top = 1 << (bits - 1), (1 << bits) - 1
    u, v = cb - centre, cr - centre
    return (clamp(y + shr(FIX_R_CR * v + HALF, 16), 0, top), clamp(y - shr(FIX_G_CB * u + FIX_G_CR * v + HALF, 16), 0, top), clamp(y + shr(FIX_B_CB * u + HALF, 16), 0, top))


def inverted_cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column, bits: int = 8) -> tuple[Column, ...]:
    """Complemented inks times complemented black, rounded."""
    top = (1 << bits) - 1
    return tuple(F.call_function("div", v * k + top // 2, big(top)) for v in (c, m, y))


def ycck_to_rgb(y: Column, cb: Column, cr: Column, k: Column, bits: int = 8) -> tuple[Column, ...]:
    return inverted_cmyk_to_rgb(*ycbcr_to_rgb(y, cb, cr, bits), k, bits)


def sycc_to_rgb(y: Column, cb: Column, cr: Column, bits: int = 8) -> tuple[Column, ...]:
    """Floating sYCC, clamped to the depth."""
    half, top = float(1 << (bits - 1)), float((1 << bits) - 1)
    return tuple(F.greatest(F.least(v, F.lit(top)), F.lit(0.0)) for v in _matrix(((1.0, 0.0, 1.402), (1.0, -0.344136, -0.714136), (1.0, 1.772, 0.0)), (y, cb.cast("double") - half, cr.cast("double") - half)))


def level_shift(bits: Column, signed) -> Column:
    return F.when(signed, big(0)).otherwise(F.call_function("shiftleft", big(1), (bits - 1).cast("int")))


def sample_range(bits: Column, signed) -> tuple[Column, Column]:
    half = F.call_function("shiftleft", big(1), (bits - 1).cast("int"))
    return F.when(signed, -half).otherwise(big(0)), F.when(signed, half - 1).otherwise(2 * half - 1)


def sample_as_u8(value: Column, bits: int) -> Column:
    """Rounded first; other depths than 8 are clamped to their range, scaled and rounded again."""
    top = 65535 if bits >= 16 else (1 << bits) - 1
    v = F.greatest(F.least(F.round(value.cast("double")), F.lit(float(top))), F.lit(0.0))
    return (v if bits == 8 else F.round(v / float(top) * 255.0)).cast("bigint")


def sign_extend(raw: Column, bits: int) -> Column:
    """The low bits as two's complement."""
    return F.shiftright(F.shiftleft(raw.cast("bigint"), 64 - bits), 64 - bits)


def infer_colorspace(components: Column, mct: Column, reversible: Column) -> Column:
    return F.when(components == 1, "grayscale").when((components >= 3) & mct & reversible, "rct").when((components >= 3) & mct, "ict").when(components.isin(3, 4), "rgb").otherwise("unknown")
