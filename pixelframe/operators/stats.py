"""Reductions: histograms, equalisation, counts, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..layout import COLORS, PIXEL_COLUMNS, attach, heads, idiv, is_small, packed_rgb
from .lines import equalised

BIN_565 = (5, 6, 5)


def bin_565() -> Column:
    """Upper 5, 6 and 5 bits of r, g, b as one number in 0..65535."""
    return (
        F.shiftleft(F.shiftright("r", 3), 11)
        .bitwiseOR(F.shiftleft(F.shiftright("g", 2), 5))
        .bitwiseOR(F.shiftright("b", 3))
    )


def bin_color(bin_col: Column) -> dict[str, Column]:
    """The 8-bit colour of a bin: its top bits repeat below, so white stays white."""
    r, g, b = F.shiftright(bin_col, 11), F.shiftright(bin_col, 5).bitwiseAND(F.lit(63)), bin_col.bitwiseAND(F.lit(31))
    wide = lambda v, up, down: F.shiftleft(v, up).bitwiseOR(F.shiftright(v, down)).cast("int")
    return {"r": wide(r, 3, 2), "g": wide(g, 2, 4), "b": wide(b, 3, 2)}


def channel_histogram(df: DataFrame, region: Column | None = None) -> DataFrame:
    """(image_id, channel, value, n). At most 768 partial groups per image."""
    picked = df if region is None else df.where(region)
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in COLORS]
        )
    )
    return (
        picked.select("image_id", pairs.alias("s"))
        .groupBy("image_id", "s.channel", "s.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gray_histogram(df: DataFrame, region: Column | None = None) -> DataFrame:
    picked = df if region is None else df.where(region)
    return picked.groupBy("image_id", F.col("r").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def color_histogram_565(df: DataFrame, region: Column | None = None) -> DataFrame:
    """(image_id, bin, n), counts are BIGINT and do not saturate."""
    picked = df if region is None else df.where(region)
    return picked.groupBy("image_id", bin_565().alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def delta_weighted_histogram(df: DataFrame, gray: bool = False) -> DataFrame:
    """5-6-5 bins weighted by the colour step from the left neighbour.

    The window is one scan line (bounded by the image width).
    """
    line = Window.partitionBy("image_id", "y").orderBy("x")
    left = df.select(
        "image_id",
        bin_565().alias("bin"),
        *[
            (F.coalesce(F.lag(c).over(line), F.lit(0)) - F.col(c)).alias(f"d{c}")
            for c in COLORS
        ],
    )
    dr, dg, db = F.col("dr"), F.col("dg"), F.col("db")
    if gray:
        weight = F.abs(dr).cast("bigint")
    else:
        step = (
            F.when((dr < dg) & (dr < db), dg * dg + db * db)
            .when(dg < db, dr * dr + db * db)
            .otherwise(dr * dr + dg * dg)
        )
        weight = F.floor(F.sqrt(step)).cast("bigint")
    return left.groupBy("image_id", "bin").agg(F.sum(weight).alias("weight"))


def color_count(df: DataFrame, region: Column | None = None) -> DataFrame:
    """Exact number of distinct RGB values per image, alpha ignored.

    Distinct first on (image, colour), which spreads over all tasks, then count.
    """
    picked = df if region is None else df.where(region)
    return (
        picked.select("image_id", packed_rgb().alias("rgb"))
        .distinct()
        .groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("colors"))
    )


def color_count_estimate(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    return df.groupBy("image_id").agg(
        F.approx_count_distinct(packed_rgb(), rsd).alias("colors")
    )


def equalisation_curve(hist: DataFrame) -> DataFrame:
    """(image_id, channel, value, mapped) from a channel histogram.

    Windows run over at most 256 histogram rows.
    """
    per = Window.partitionBy("image_id", "channel")
    upto = per.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(
        "image_id",
        "channel",
        "value",
        idiv(F.sum("n").over(upto) * 255, F.sum("n").over(per)).cast("int").alias("mapped"),
    )


def curve_arrays(curve: DataFrame) -> DataFrame:
    """One row per image with a 256-entry array per channel.

    A value that does not occur maps as the nearest lower one (0 before the
    first): each row is repeated up to the next value and the runs are joined.
    """
    order = Window.partitionBy("image_id", "channel").orderBy("value")
    run = F.array_repeat(F.col("mapped"), F.lead("value", 1, 256).over(order) - F.col("value"))
    lead_in = F.array_repeat(
        F.lit(0), F.when(F.lag("value").over(order).isNull(), F.col("value")).otherwise(0)
    )
    runs = curve.select("image_id", "channel", "value", F.concat(lead_in, run).alias("run"))
    pick = lambda c: F.flatten(
        F.sort_array(
            F.collect_list(F.when(F.col("channel") == c, F.struct("value", "run")))
        )["run"]
    )
    return runs.groupBy("image_id").agg(*[pick(c).alias(f"lut_{c}") for c in COLORS])


def lut_apply_per_image(
    df: DataFrame, tables: DataFrame, region: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Map colours through tables (image_id, lut_r, lut_g, lut_b).

    An image without a table stays as it is.
    """
    joined = attach(df, tables, "left", rows=rows)
    new = {}
    for c in COLORS:
        mapped = F.coalesce(F.get(F.col(f"lut_{c}"), F.col(c)), F.col(c))
        new[c] = mapped if region is None else F.when(region, mapped).otherwise(F.col(c))
    return joined.withColumns(new).drop("lut_r", "lut_g", "lut_b")


def stretch_tables(df: DataFrame) -> DataFrame:
    """Per-image tables that scale the brightest red sample to 255."""
    top = df.groupBy("image_id").agg(F.max("r").alias("hi"))
    ramp = F.transform(
        F.sequence(F.lit(0), F.lit(255)),
        lambda v: F.least(
            F.lit(255), idiv(v * 255, F.greatest(F.col("hi"), F.lit(1)))
        ).cast("int"),
    )
    return top.select("image_id", *[ramp.alias(f"lut_{c}") for c in COLORS])


def hist_eq_global(
    df: DataFrame, region: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Equalise each colour over the selection: 255 * cum(v) div N.

    Whole images that aren't proven few go as scan lines, not as pixels.
    """
    if region is None and not is_small(rows) and set(df.columns) == set(PIXEL_COLUMNS):
        new = equalised(df)
        if new is not None:
            return new.select(*df.columns)
    tables = curve_arrays(equalisation_curve(channel_histogram(df, region)))
    return lut_apply_per_image(df, tables, region, rows)


def background_color(df: DataFrame) -> DataFrame:
    """Average of the four corner pixels per image."""
    last_x, last_y = F.col("width") - 1, F.col("height") - 1
    times = ((F.col("x") == 0).cast("int") + (F.col("x") == last_x).cast("int")) * (
        (F.col("y") == 0).cast("int") + (F.col("y") == last_y).cast("int")
    )
    corners = df.where(F.col("x").isin(0) | (F.col("x") == last_x)).where(
        F.col("y").isin(0) | (F.col("y") == last_y)
    )
    return corners.groupBy("image_id").agg(
        *[idiv(F.sum(F.col(c) * times), 4).cast("int").alias(c) for c in COLORS]
    )


def corner_pixel(df: DataFrame) -> DataFrame:
    """Colour of pixel (0, 0) per image as (image_id, _cr, _cg, _cb)."""
    return heads(df).select("image_id", *[F.col(c).alias(f"_c{c}") for c in COLORS])


def content_bbox(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Half-open box of the pixels that differ from pixel (0, 0).

    Images of one colour only have no row.
    """
    differs = (
        (F.col("r") != F.col("_cr")) | (F.col("g") != F.col("_cg")) | (F.col("b") != F.col("_cb"))
    )
    return (
        attach(df, corner_pixel(df), rows=rows)
        .where(differs)
        .groupBy("image_id")
        .agg(
            F.min("x").alias("x0"),
            F.min("y").alias("y0"),
            (F.max("x") + 1).alias("x1"),
            (F.max("y") + 1).alias("y1"),
        )
    )


def grey_intensity_preview(df: DataFrame, width: int, height: int) -> DataFrame:
    """Down-sampled (r+g+b)/3 picture of each image."""
    from ..functions.color import intensity
    from .geometry import thumbnail

    small = thumbnail(df, width, height)
    return small.select("image_id", "y", "x", intensity().alias("v"))


def image_stats(df: DataFrame, payload_bytes: Column | int = 0) -> DataFrame:
    """Capacity in samples and the share of LSBs a payload would use."""
    components = F.lit(3) + F.col("a").isNotNull().cast("int")
    sized = heads(df).withColumn(
        "capacity", F.col("width").cast("bigint") * F.col("height") * components
    )
    used = payload_bytes if isinstance(payload_bytes, Column) else F.lit(payload_bytes)
    return sized.select(
        "image_id",
        "width",
        "height",
        "capacity",
        idiv(used.cast("bigint") * 800, F.col("capacity")).alias("used_percent"),
    )
