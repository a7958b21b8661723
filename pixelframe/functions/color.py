"""Point operators that combine the channels of a pixel."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..layout import CHANNELS, COLORS, attach, clamp8, idiv, require
from .tone import apply_in_region

Rgb = tuple[int, int, int]


def luma() -> Column:
    return idiv(F.col("r") * 30 + F.col("g") * 59 + F.col("b") * 11, 100).cast("int")


def intensity() -> Column:
    return idiv(F.col("r") + F.col("g") + F.col("b"), 3).cast("int")


def grayscale(df: DataFrame, region: Column | None = None) -> DataFrame:
    """Weighted gray. On the whole raster the result has no alpha channel."""
    changes = {c: luma() for c in COLORS}
    if region is None:
        changes["a"] = F.lit(None).cast("int")
    return apply_in_region(df, changes, region)


def truecolor(df: DataFrame) -> DataFrame:
    """RGB without alpha; gray rasters already carry r = g = b."""
    return df.withColumn("a", F.lit(None).cast("int"))


def threshold_intensity(
    df: DataFrame, limit: int, region: Column | None = None
) -> DataFrame:
    require(0 <= limit <= 255, "limit lies in 0..255")
    value = F.when(intensity() < limit, 0).otherwise(255)
    return apply_in_region(df, {c: value for c in COLORS}, region)


def extract_channels(
    df: DataFrame, keep: str, region: Column | None = None
) -> DataFrame:
    """Zero every channel whose letter is not in ``keep`` (for example "rb")."""
    require(set(keep) <= set(CHANNELS), "channels are letters of argb")
    zero = {c: F.lit(0) for c in COLORS if c not in keep}
    if "a" not in keep:
        zero["a"] = F.when(F.col("a").isNotNull(), F.lit(0))
    return apply_in_region(df, zero, region)


def mix_factors(text: str) -> list[int]:
    """Factors "r,g,b[,a]" in thousandths."""
    parts = [float(p) for p in text.split(",")]
    require(3 <= len(parts) <= 4, "a mix has three or four factors")
    return [int(round(p * 1000)) for p in parts] + [0] * (4 - len(parts))


def color_mix(
    df: DataFrame,
    red: str = "1,0,0",
    green: str = "0,1,0",
    blue: str = "0,0,1",
    alpha: str | None = None,
    region: Column | None = None,
) -> DataFrame:
    """Matrix of factors; each term is truncated before the sum is clamped."""

    def term(channel: str, k: int) -> Column:
        return F.coalesce(idiv(F.col(channel) * k, 1000), F.lit(0))

    def row(text: str) -> Column:
        fr, fg, fb, fa = mix_factors(text)
        total = F.lit(0)
        for channel, k in (("r", fr), ("g", fg), ("b", fb), ("a", fa)):
            if k:
                total = total + term(channel, k)
        return clamp8(total)

    changes = {"r": row(red), "g": row(green), "b": row(blue)}
    if alpha is not None:
        changes["a"] = F.when(F.col("a").isNotNull(), row(alpha))
    return apply_in_region(df, changes, region)


def distance2(color: Rgb | list[Column]) -> Column:
    """Squared RGB distance of the pixel to a colour."""
    total = F.lit(0)
    for channel, value in zip(COLORS, color):
        d = F.col(channel) - value
        total = total + d * d
    return total


def color_change(
    df: DataFrame,
    source: Rgb,
    target: Rgb,
    tolerance: int = 0,
    region: Column | None = None,
) -> DataFrame:
    """Move colours near ``source`` by the offset target - source."""
    near = distance2(source) <= tolerance * tolerance
    changes = {
        c: F.when(near, clamp8(F.col(c) + (t - s))).otherwise(F.col(c))
        for c, s, t in zip(COLORS, source, target)
    }
    return apply_in_region(df, changes, region)


def transparency(
    df: DataFrame,
    alpha: int,
    color: Rgb | list[Column] | None = None,
    tolerance: int = 0,
    everything: bool = False,
    region: Column | None = None,
    background: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Set alpha on pixels near a colour (or on all); others keep theirs or get 0.

    ``background`` takes the background colour of each image; ``rows`` bounds the
    number of images.
    """
    require(0 <= alpha <= 255, "alpha lies in 0..255")
    given = everything + background + (color is not None)
    require(given == 1, "give a colour, background=True or everything=True")
    if background:
        from ..operators.stats import background_color

        back = background_color(df).toDF("image_id", "_br", "_bg", "_bb")
        joined = attach(df, back, "left", rows=rows)
        near = [F.col(c) for c in ("_br", "_bg", "_bb")]
        return transparency(joined, alpha, near, tolerance, region=region).select(*df.columns)
    hit = F.lit(True) if everything else distance2(color) <= tolerance * tolerance
    if region is not None:
        hit = hit & region
    kept = F.coalesce(F.col("a"), F.lit(0))
    return df.withColumn("a", F.when(hit, F.lit(alpha)).otherwise(kept))


def flatten_alpha(df: DataFrame) -> DataFrame:
    """Blend over black and drop the alpha channel."""
    opaque = 255 - F.coalesce(F.col("a"), F.lit(0))
    changes = {
        c: F.when(F.col("a").isNull(), F.col(c)).otherwise(
            F.shiftright(F.col(c) * opaque, 8)
        )
        for c in COLORS
    }
    return apply_in_region(df, {**changes, "a": F.lit(None).cast("int")})


def pixel_udf(
    df: DataFrame,
    fn: Callable[[Column, Column, Column, Column, Column], tuple[Column, Column, Column]],
    region: Column | None = None,
) -> DataFrame:
    """User function of (r, g, b, row, col) written with Columns; stays in the JVM."""
    new = fn(F.col("r"), F.col("g"), F.col("b"), F.col("y"), F.col("x"))
    return apply_in_region(df, {c: clamp8(v) for c, v in zip(COLORS, new)}, region)


def pixel_udf_arrays(df: DataFrame, fn: Callable, region: Column | None = None) -> DataFrame:
    """Same hook for a function of NumPy arrays, sent in Arrow batches."""
    @F.pandas_udf("r int, g int, b int")
    def run(
        r: pd.Series, g: pd.Series, b: pd.Series, row: pd.Series, col: pd.Series
    ) -> pd.DataFrame:
        new = fn(*(s.to_numpy() for s in (r, g, b, row, col)))
        return pd.DataFrame(
            {c: pd.Series(v).clip(0, 255).astype("int32") for c, v in zip(COLORS, new)}
        )

    out = df.withColumn("_new", run("r", "g", "b", "y", "x"))
    changes = {c: F.col(f"_new.{c}") for c in COLORS}
    return apply_in_region(out, changes, region).drop("_new")
