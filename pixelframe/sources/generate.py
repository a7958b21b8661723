"""Rasters made from sizes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..layout import MAX_SIDE, as_pixels, require, span


def grid(images: DataFrame) -> DataFrame:
    """Every cell of each image; lines are made first and dealt over the tasks."""
    return (
        images.select("image_id", "width", "height")
        .withColumn("y", F.explode(span(F.lit(0), F.col("height"))))
        .repartition("image_id", "y")
        .withColumn("x", F.explode(span(F.lit(0), F.col("width"))))
    )


def constant_raster(images: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """One colour over the size of each row of ``images``; a size out of range is an error."""
    require(all(0 <= c <= 255 for c in color), "colours lie in 0..255")
    r, g, b = (F.lit(c) for c in color)
    fits = F.col("width").between(1, MAX_SIDE) & F.col("height").between(1, MAX_SIDE)
    checked = F.when(fits, F.col("height")).otherwise(
        F.raise_error(F.concat(F.lit("size out of range: image "), F.col("image_id").cast("string")))
    )
    return as_pixels(
        grid(images.withColumn("height", checked.cast("int"))).withColumns({"a": F.lit(None).cast("int"), "r": r, "g": g, "b": b})
    )
