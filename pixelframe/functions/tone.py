"""Point operators that treat every channel alike.

Each takes a pixel DataFrame and returns one of the same layout. ``region`` is
a boolean Column (see operators.regions); pixels outside it are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import CHANNELS, COLORS, clamp8, require


def apply_in_region(
    df: DataFrame, changes: dict[str, Column], region: Column | None = None
) -> DataFrame:
    """Replace channels by expressions of the pixel, inside the region only."""
    return df.withColumns(
        {
            name: new.cast("int")
            if region is None
            else F.when(region, new.cast("int")).otherwise(F.col(name))
            for name, new in changes.items()
        }
    )


def add_constant(
    df: DataFrame,
    red: int = 0,
    green: int = 0,
    blue: int = 0,
    alpha: int = 0,
    grey: int | None = None,
    region: Column | None = None,
) -> DataFrame:
    """clamp(c + k). ``grey`` is the one constant of a gray raster."""
    if grey is not None:
        red = green = blue = grey
    for k in (red, green, blue, alpha):
        require(-255 <= k <= 255, "constants lie in -255..255")
    ks = {"a": alpha, "r": red, "g": green, "b": blue}
    # least/greatest skip NULL, so a missing alpha must be kept explicitly
    changes = {c: clamp8(F.col(c) + k) for c, k in ks.items()}
    changes["a"] = F.when(F.col("a").isNotNull(), changes["a"])
    return apply_in_region(df, changes, region)


def lut_apply(
    df: DataFrame, table: list[int], region: Column | None = None
) -> DataFrame:
    """Map the colours through a 256-entry table held as one literal array."""
    require(len(table) == 256, "a lookup table has 256 entries")
    lut = F.lit([int(v) for v in table])
    return apply_in_region(df, {c: lut[F.col(c)] for c in COLORS}, region)


def brightness_table(amount: float) -> list[int]:
    require(-1 <= amount <= 1, "brightness amount lies in -1..1")
    gain = 1000 + int(1000 * amount)
    return [min(255, v * gain // 1000) for v in range(256)]


def contrast_table(amount: float) -> list[int]:
    """A line through the middle; positive amounts steepen it."""
    require(-1 <= amount <= 1, "contrast amount lies in -1..1")
    c = abs(int(1000 * amount)) * 128 / 1000.0
    if amount <= 0:
        run, rise, start = 256.0, 256.0 - 2.0 * c, c
    else:
        run = (256.0 - 2.0 * c) or 1.0
        rise, start = 256.0, 128.0 - 32768.0 / run
    return [int(min(255.0, max(0.0, rise * v / run + start))) for v in range(256)]


def gamma_table(value: float) -> list[int]:
    require(0.001 <= value <= 10, "gamma lies in 0.001..10")
    return [
        int(min(255.0, math.pow(v / 255.0, 1.0 / value) * 255.0 + 0.5))
        for v in range(256)
    ]


def brightness(df: DataFrame, amount: float, region: Column | None = None) -> DataFrame:
    return lut_apply(df, brightness_table(amount), region)


def contrast(df: DataFrame, amount: float, region: Column | None = None) -> DataFrame:
    return lut_apply(df, contrast_table(amount), region)


def gamma(df: DataFrame, value: float, region: Column | None = None) -> DataFrame:
    return lut_apply(df, gamma_table(value), region)


def negative(df: DataFrame, region: Column | None = None) -> DataFrame:
    return apply_in_region(df, {c: 255 - F.col(c) for c in COLORS}, region)


def threshold_channel(
    df: DataFrame, limit: int, region: Column | None = None
) -> DataFrame:
    """0 below the limit, else 255, on every component including alpha."""
    require(0 <= limit <= 255, "limit lies in 0..255")
    cut = {
        c: F.when(F.col(c) < limit, 0).when(F.col(c) >= limit, 255) for c in CHANNELS
    }
    return apply_in_region(df, cut, region)


def bitfield(
    df: DataFrame, low: int, high: int, region: Column | None = None
) -> DataFrame:
    """Keep bits low..high of every component, moved up to the top bit."""
    require(0 <= low <= high <= 7, "bits satisfy 0 <= low <= high <= 7")
    mask = (1 << (high + 1)) - (1 << low)
    return apply_in_region(
        df,
        {c: F.shiftleft(F.col(c).bitwiseAND(F.lit(mask)), 7 - high) for c in CHANNELS},
        region,
    )
