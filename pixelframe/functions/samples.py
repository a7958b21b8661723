"""Column functions on single samples: packing, rescaling, colour spaces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..layout import as_col, clamp8, idiv


def pack_argb(a, r, g, b) -> Column:
    """One BIGINT word, 8 bits per channel, alpha highest."""
    word = F.shiftleft(as_col(a).cast("bigint"), 24)
    for channel, shift in ((r, 16), (g, 8), (b, 0)):
        word = word.bitwiseOR(F.shiftleft(as_col(channel).cast("bigint"), shift))
    return word


def unpack_argb(word: Column) -> dict[str, Column]:
    byte = lambda shift: F.shiftright(word, shift).bitwiseAND(F.lit(255)).cast("int")
    return {"a": byte(24), "r": byte(16), "g": byte(8), "b": byte(0)}


def rescale_samples(value: Column, maxval: int) -> Column:
    """Samples with maximum ``maxval`` to 8 bits, rounded to nearest."""
    return idiv(value.cast("bigint") * 255 + maxval // 2, maxval).cast("int")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """u and v are signed differences; fixed point in thousandths."""
    y, u, v = (as_col(c).cast("bigint") for c in (y, u, v))
    return {
        "r": clamp8(idiv(y * 1000 + v * 1140, 1000)),
        "g": clamp8(idiv(y * 1000 - u * 396 - v * 581, 1000)),
        "b": clamp8(idiv(y * 1000 + u * 2029, 1000)),
    }
