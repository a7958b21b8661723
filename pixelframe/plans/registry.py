"""Operators by name, and recipes: lists of (name, arguments).

A recipe is folded over a DataFrame into one lazy plan; ``image_id`` is a
column like any other, so the same recipe runs over all frames at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame

from ..functions import color, noise, ordered, tone
from ..functions.kernels import preset
from ..layout import RasterArgumentError
from ..operators import combine, geometry, quantize, remap, stats, stencil, watermark

Operator = Callable[..., DataFrame]
Step = tuple[str, Mapping[str, Any]]


def _convolve(df: DataFrame, kernel: str, region=None) -> DataFrame:
    return stencil.convolve(df, preset(kernel), region)


def _resize(df: DataFrame, width, height, fill: str = "black") -> DataFrame:
    return geometry.resize_canvas(df, width, height, fill)


def _composite(df: DataFrame, source: DataFrame, pairs: DataFrame, method: str = "direct", ratio: int = 128,
               rows: int | None = None) -> DataFrame:
    return combine.composite(df, combine.place(source, pairs, rows), method, ratio)


def _render(df: DataFrame, **arguments: Any) -> DataFrame:
    """Rendered pixels in the colours of their pens."""
    indexed, palettes = quantize.render_indexed(df, **arguments)
    sized = df.select("image_id", "width", "height", "y", "x", "a").join(indexed, ["image_id", "y", "x"])
    return quantize.expand_indexed(sized, palettes, arguments.get("rows")).select(*df.columns)


# Stateless projections and filters: these also run on a streaming DataFrame.
POINT_OPERATORS: dict[str, Operator] = {
    "ADDCONSTANT": tone.add_constant,
    "BITFIELD": tone.bitfield,
    "BRIGHTNESS": tone.brightness,
    "COLORCHANGE": color.color_change,
    "COLORMIX": color.color_mix,
    "CONTRAST": tone.contrast,
    "EXTRACT": color.extract_channels,
    "FLATTEN": color.flatten_alpha,
    "GAMMA": tone.gamma,
    "GREYSCALE": color.grayscale,
    "NEGATIVE": tone.negative,
    "NOISE_ADDITIVE": noise.noise_additive,
    "NOISE_MULTIPLICATIVE": noise.noise_multiplicative,
    "NOISE_SALT_PEPPER": noise.noise_salt_pepper,
    "ORDERED_DITHER": ordered.ordered_dither,
    "THRESHOLD": tone.threshold_channel,
    "THRESHOLD_INTENSITY": color.threshold_intensity,
    "TRANSPARENCY": color.transparency,
    "TRUECOLOR": color.truecolor,
    "CROP": geometry.crop,
    "FLIPX": geometry.flip_x,
    "FLIPY": geometry.flip_y,
    "ROLL": geometry.roll,
}

OPERATORS: dict[str, Operator] = {
    **POINT_OPERATORS,
    "ADDALPHA": combine.add_alpha,
    "AUTOCROP": geometry.autocrop,
    "BLUR": stencil.box_blur_separable,
    "COLORCOUNT": stats.color_count,
    "COMPOSITE": _composite,
    "COMPOSITE_TILE": combine.composite_tile,
    "CONVOLUTE": _convolve,
    "EMBEDFILE": watermark.embed,
    "EXTRACTFILE": watermark.extract,
    "HISTEQ": stats.hist_eq_global,
    "HISTEQ_LOCAL": stencil.hist_eq_local,
    "MEDIAN": stencil.median,
    "REMOVEISOLATED": stencil.remove_isolated,
    "RENDER": _render,
    "TEXT": combine.stamp_mask,
    "RESIZE": _resize,
    "ROTATE": geometry.rotate_nn,
    "ROTATE_BILINEAR": geometry.rotate_bilinear,
    "SCALE": geometry.scale_quick,
    "SCALE_AVERAGE": geometry.scale_average,
    "SHEARX": geometry.shear_h,
    "SHEARY": geometry.shear_v,
    "SHIFT": geometry.shift,
    "TWIRL": geometry.twirl_nn,
    "TWIRL_BILINEAR": geometry.twirl_bilinear,
}


def process(df: DataFrame, name: str, /, **arguments: Any) -> DataFrame:
    """Run one operator by name (any case) with keyword arguments."""
    try:
        operator = OPERATORS[name.upper()]
    except KeyError:
        raise RasterArgumentError(f"unknown operator {name}") from None
    return operator(df, **arguments)


def recipe(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Run operators in turn; a run of canvas steps becomes one map with one fill."""
    maps = [(name, arguments, remap.step(name, arguments)) for name, arguments in steps]
    for foldable, run in groupby(maps, key=lambda m: m[2] is not None):
        run = list(run)
        if foldable and len(run) > 1:
            df = remap.folded(df, [move for _, _, move in run])
            continue
        for name, arguments, _ in run:
            df = process(df, name, **arguments)
    return df


def frame_recipe(
    width: int,
    height: int,
    new_width: int,
    new_height: int,
    border: int = 3,
    gray: bool = True,
    left_share: int = 50,
    bottom_share: int = 50,
) -> list[Step]:
    """Put pictures of one size into a frame: contrast border, gray, canvas, roll.

    The shares say what percentage of the free space goes left and below.
    """
    steps: list[Step] = []
    if border:
        steps.append(
            ("RESIZE", {"width": width + 2 * border, "height": height + 2 * border, "fill": "white"})
        )
    if gray:
        steps.append(("GREYSCALE", {}))
    steps.append(("RESIZE", {"width": new_width, "height": new_height, "fill": "black"}))
    free_x, free_y = new_width - width, new_height - height
    dx = free_x * left_share // 100 - free_x // 2
    dy = free_y // 2 - free_y * bottom_share // 100
    steps.append(("ROLL", {"dx": dx, "dy": dy}))
    return steps
