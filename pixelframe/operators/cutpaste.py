"""Cutting a selection out of a raster and pasting it into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import COLORS
from ..functions.tone import apply_in_region
from .combine import composite
from .geometry import crop
from .regions import circle, circle_bbox


def cut_to_frame(df: DataFrame, box: tuple[int, int, int, int], region: Column) -> DataFrame:
    """The box as a raster of its own; pixels outside the region are transparent."""
    marked = df.withColumn("a", F.when(region, F.lit(0)).otherwise(F.lit(255)))
    return crop(marked, *box)


def cut_circle(df: DataFrame, cx: int, cy: int, radius: int) -> DataFrame:
    from ..layout import MAX_SIDE

    box = circle_bbox(cx, cy, radius, MAX_SIDE, MAX_SIDE)
    return cut_to_frame(df, box, circle(cx, cy, radius))


def cut_erase(df: DataFrame, region: Column) -> DataFrame:
    """Zero the colours of the selection."""
    return apply_in_region(df, {c: F.lit(0) for c in COLORS}, region)


def paste(df: DataFrame, piece: DataFrame, top: int, left: int) -> DataFrame:
    """Lay a cut piece over the raster of the same number."""
    placed = piece.select(
        "image_id",
        (F.col("y") + top).alias("y"),
        (F.col("x") + left).alias("x"),
        F.col("a").alias("s_a"),
        *[F.col(c).alias(f"s_{c}") for c in COLORS],
    )
    return composite(df, placed, "direct")
