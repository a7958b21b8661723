"""Ordered dithering with a Bayer matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..layout import COLORS
from .tone import apply_in_region


def bayer(order: int) -> list[int]:
    """Row-major 2^order square: bits of x xor y and of y interleaved, reversed."""
    side = 1 << order
    cells = []
    for y in range(side):
        for x in range(side):
            bits = [((x ^ y) >> i & 1) * 2 + (y >> i & 1) for i in range(order)]
            cells.append(sum(b << 2 * (order - 1 - i) for i, b in enumerate(bits)))
    return cells


def ordered_dither(df: DataFrame, order: int = 2) -> DataFrame:
    """Raise each sample by its matrix cell, scaled so that white stays below 256."""
    side = 1 << order
    cell = F.lit(bayer(order))[(F.col("y") % side) * side + F.col("x") % side]
    lifted = {
        c: F.shiftright(F.shiftleft(F.col(c) + cell, 4) - F.col(c), 4) for c in COLORS
    }
    return apply_in_region(df, lifted)
