"""Operators on two rasters: matched by equi joins on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import COLORS, SALTS, attach, heads, idiv, is_small, require, shuffled, span

METHODS = (
    "direct",
    "minimum",
    "maximum",
    "mix",
    "transparent_black",
    "add",
    "subtract",
    "multiply",
)


def _length2(prefix: str) -> Column:
    total = F.lit(0)
    for c in COLORS:
        total = total + F.col(prefix + c) * F.col(prefix + c)
    return total


def _blend(method: str, ratio: int) -> dict[str, Column]:
    """New colour of a destination pixel (r, g, b) under a source (s_r, s_g, s_b)."""
    require(method in METHODS, f"unknown method {method}")
    require(0 <= ratio <= 255, "ratio lies in 0..255")
    out = {}
    for c in COLORS:
        s, t = F.col(f"s_{c}"), F.col(c)
        if method == "direct":
            out[c] = s
        elif method == "minimum":
            out[c] = F.when(_length2("") > _length2("s_"), s).otherwise(t)
        elif method == "maximum":
            out[c] = F.when(_length2("") < _length2("s_"), s).otherwise(t)
        elif method == "mix":
            out[c] = idiv(s * ratio + t * (255 - ratio), 255)
        elif method == "transparent_black":
            black = (F.col("s_r") == 0) & (F.col("s_g") == 0) & (F.col("s_b") == 0)
            out[c] = F.when(black, t).otherwise(s)
        elif method == "add":
            out[c] = F.least(F.lit(255), s + t)
        elif method == "subtract":
            out[c] = F.greatest(F.lit(0), t - s)
        else:
            out[c] = F.shiftright(t * s, 8)
    return out


def attach_frames(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Chain rows (dst_id, src_id, seq) with the sizes of the attached frames."""
    sizes = images.select(
        F.col("image_id").alias("src_id"),
        F.col("width").alias("src_width"),
        F.col("height").alias("src_height"),
    )
    return attach(pairs, sizes, slot=F.xxhash64("dst_id"), key="src_id")


PAIRS_PER_PART = 1024


def deal(source: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Source pixels beside each of their pairs (dst_id, src_id, ...).

    Pairs proven few by ``rows`` are broadcast. Otherwise a source used by very
    many destinations (a logo) is copied once per PAIRS_PER_PART of its pairs
    and those are dealt over the copies, while scan lines are dealt over slots:
    neither a popular nor a very large source ends up in one task.
    """
    keyed = pairs.withColumnRenamed("src_id", "image_id")
    if is_small(rows):
        return attach(source, keyed, rows=rows)
    parts = keyed.groupBy("image_id").agg(
        (idiv(F.count(F.lit(1)), PAIRS_PER_PART) + 1).alias("_parts")
    )
    slots = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = (
        attach(keyed, parts, slot=F.xxhash64("dst_id"))
        .withColumn("_part", F.pmod(F.xxhash64("dst_id"), F.col("_parts")))
        .withColumn("_slot", slots)
        .drop("_parts")
    )
    copies = (
        attach(source, parts)
        .withColumn("_part", F.explode(span(F.lit(0).cast("bigint"), F.col("_parts"))))
        .withColumn("_slot", F.pmod(F.col("y"), F.lit(SALTS)).cast("int"))
        .drop("_parts")
    )
    return copies.join(shuffled(dealt), ["image_id", "_part", "_slot"]).drop("_part", "_slot")


def place(source: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Source pixels in destination coordinates.

    ``pairs`` has (dst_id, src_id, top, left), at most one source per
    destination.
    """
    return (
        deal(source, pairs, rows)
        .select(
            F.col("dst_id").alias("image_id"),
            (F.col("y") + F.col("top")).alias("y"),
            (F.col("x") + F.col("left")).alias("x"),
            F.col("a").alias("s_a"),
            *[F.col(c).alias(f"s_{c}") for c in COLORS],
        )
        .where((F.col("y") >= 0) & (F.col("x") >= 0))
    )


def composite(
    destination: DataFrame, placed: DataFrame, method: str = "direct", ratio: int = 128
) -> DataFrame:
    """Combine placed source pixels with the destination, pixel by pixel.

    The join key (image_id, y, x) is unique on both sides, so no key is hot.
    A source with alpha is blended over the destination after the method.
    """
    joined = destination.join(shuffled(placed), ["image_id", "y", "x"], "left")
    return _combined(joined, method, ratio).select(*destination.columns)


def _combined(joined: DataFrame, method: str, ratio: int) -> DataFrame:
    new = {}
    for c, value in _blend(method, ratio).items():
        mixed = F.shiftright((255 - F.col("s_a")) * value + F.col("s_a") * F.col(c), 8)
        value = F.when(F.col("s_a").isNull(), value).otherwise(mixed)
        new[c] = F.when(F.col("s_r").isNull(), F.col(c)).otherwise(value).cast("int")
    return joined.withColumns(new)


def tile(
    destination: DataFrame,
    source: DataFrame,
    pairs: DataFrame,
    region: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Source pixels repeated over their destination's selection.

    ``pairs`` has (dst_id, src_id, top, left, src_width, src_height). A source
    pixel is copied forward to every destination cell it covers, so each row of
    the later join has its own key and a small tile does not become a hot key.
    """
    sizes = heads(destination).select(
        F.col("image_id").alias("dst_id"),
        F.col("width").alias("dst_width"),
        F.col("height").alias("dst_height"),
    )
    spread = deal(source, pairs.join(sizes, "dst_id"), rows)

    def repeats(at: str, offset: str, step: str, size: str) -> Column:
        first = F.pmod(F.col(at) + F.col(offset), F.col(step))
        count = idiv(F.col(size) - first + F.col(step) - 1, F.col(step))
        return F.explode(
            F.transform(span(F.lit(0), count), lambda i: (first + i * F.col(step)).cast("int"))
        )

    placed = (
        spread.withColumn("ty", repeats("y", "top", "src_height", "dst_height"))
        .repartition("dst_id", "ty")  # lines first: a tiny tile must not fill an image in one task
        .withColumn("tx", repeats("x", "left", "src_width", "dst_width"))
        .select(
            F.col("dst_id").alias("image_id"),
            F.col("ty").alias("y"),
            F.col("tx").alias("x"),
            F.col("a").alias("s_a"),
            *[F.col(c).alias(f"s_{c}") for c in COLORS],
        )
    )
    return placed if region is None else placed.where(region)


def composite_tile(
    destination: DataFrame,
    source: DataFrame,
    pairs: DataFrame,
    method: str = "direct",
    ratio: int = 128,
    region: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``composite`` with the source repeated over the destination."""
    return composite(destination, tile(destination, source, pairs, region, rows), method, ratio)


def add_alpha(
    destination: DataFrame,
    source: DataFrame,
    pairs: DataFrame,
    use: str = "intensity",
    rows: int | None = None,
) -> DataFrame:
    """Alpha from another raster, repeated by its size over the destination."""
    require(use in ("intensity", "copy"), "use intensity or copy")
    placed = tile(
        destination, source, pairs.withColumns({"top": F.lit(0), "left": F.lit(0)}), rows=rows
    )
    if use == "intensity":
        value = idiv(F.col("s_r") + F.col("s_g") + F.col("s_b"), 3).cast("int")
    else:
        value = F.coalesce(F.col("s_a"), F.lit(0))
    new = placed.select("image_id", "y", "x", value.alias("_alpha"))
    return (
        destination.join(shuffled(new), ["image_id", "y", "x"], "left")
        .withColumn("a", F.coalesce("_alpha", "a"))
        .select(*destination.columns)
    )


def stamp_mask(
    df: DataFrame,
    mask: DataFrame,
    top: int,
    left: int,
    color: tuple[int, int, int],
    rows: int | None = None,
) -> DataFrame:
    """Write a colour where the mask (dy, dx) is set, clipped to the image.

    A mask proven small by ``rows`` is broadcast. A larger one is shuffled on
    its coordinates; the same (y, x) occurs in every image, so the key carries
    a slot of the image number as well.
    """
    marks = mask.select(
        (F.col("dy") + top).alias("y"), (F.col("dx") + left).alias("x"), F.lit(True).alias("_ink")
    ).distinct()
    if is_small(rows):
        joined = df.join(F.broadcast(marks), ["y", "x"], "left")
    else:
        slots = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        slotted = marks.withColumn("_slot", slots)
        slot = F.pmod(F.xxhash64("image_id"), F.lit(SALTS)).cast("int")
        joined = df.withColumn("_slot", slot).join(shuffled(slotted), ["y", "x", "_slot"], "left")
    return joined.withColumns(
        {
            c: F.when(F.col("_ink"), F.lit(v)).otherwise(F.col(c))
            for c, v in zip(COLORS, color)
        }
    ).select(*df.columns)
