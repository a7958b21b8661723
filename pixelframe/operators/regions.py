"""Selections: boolean Columns over (x, y), and polygons as span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import idiv, require, shuffled, span

Point = tuple[int, int]


def whole() -> Column:
    return F.lit(True)


def rect(x0: int, y0: int, x1: int, y1: int) -> Column:
    """Half-open box."""
    require(x0 <= x1 and y0 <= y1, "box corners are ordered")
    x, y = F.col("x"), F.col("y")
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def circle(cx: int, cy: int, radius: int) -> Column:
    require(radius >= 1, "radius is positive")
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return dx * dx + dy * dy <= (radius - 1) * (radius - 1)


def circle_bbox(cx: int, cy: int, radius: int, width: int, height: int) -> tuple[int, ...]:
    return (
        max(0, cx - radius + 1),
        max(0, cy - radius + 1),
        min(width, cx + radius),
        min(height, cy + radius),
    )


def polygon(vertices: list[Point]) -> Column:
    """Even-odd rule for one polygon given as literals: a sum over its edges."""
    require(len(vertices) >= 3, "a polygon has three vertices")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 == y2:
            continue
        lo, hi = min(y1, y2), max(y1, y2)
        at = x1 + (F.col("y") - y1).cast("double") * (x2 - x1) / F.lit(float(y2 - y1))
        hit = (F.col("y") >= lo) & (F.col("y") < hi) & (at > F.col("x"))
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def polygon_bbox(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Bounding box of each row's ``vertices``, clamped to the image. No shuffle."""
    xs = F.transform("vertices", lambda v: v.x)
    ys = F.transform("vertices", lambda v: v.y)

    def clip(c: Column, top: int) -> Column:
        return F.least(F.lit(top), F.greatest(F.lit(0), c)).cast("int")

    return regions.select(
        "region_id",
        clip(F.array_min(xs), width).alias("x0"),
        clip(F.array_min(ys), height).alias("y0"),
        clip(F.array_max(xs) + 1, width).alias("x1"),
        clip(F.array_max(ys) + 1, height).alias("y1"),
    )


def polygon_spans(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Many polygons at once: (region_id, y, x0, x1) runs of covered pixels.

    The range predicate "row lies within the edge" is turned into rows: an edge
    is exploded to the scan lines it crosses, so there is no range join. The
    crossings of a line are sorted and paired; a run covers ceil(c0)..ceil(c1)-1.
    """
    nxt = F.concat(F.slice("vertices", 2, F.size("vertices") - 1), F.slice("vertices", 1, 1))
    edges = regions.select(
        "region_id", F.explode(F.arrays_zip(F.col("vertices").alias("p"), nxt.alias("q")))
    ).select(
        "region_id",
        *[F.col(f"col.{v}.{c}").alias(f"{v}{c}") for v in "pq" for c in "xy"],
    )
    lines = edges.select(
        "*",
        F.explode(
            span(
                F.greatest(F.lit(0), F.least("py", "qy")),
                F.least(F.lit(height), F.greatest("py", "qy")),
            )
        ).alias("y"),
    )
    at = F.col("px") + (F.col("y") - F.col("py")).cast("double") * (
        F.col("qx") - F.col("px")
    ) / (F.col("qy") - F.col("py"))
    cuts = lines.groupBy("region_id", "y").agg(
        F.sort_array(F.collect_list(F.ceil(at).cast("int"))).alias("cuts")
    )
    pairs = cuts.select(
        "region_id",
        "y",
        "cuts",
        F.explode(span(F.lit(0), idiv(F.size("cuts"), 2))).alias("i"),
    )
    return pairs.select(
        "region_id",
        "y",
        F.greatest(F.lit(0), F.get("cuts", F.col("i") * 2)).cast("int").alias("x0"),
        F.least(F.lit(width), F.get("cuts", F.col("i") * 2 + 1)).cast("int").alias("x1"),
    ).where("x1 > x0")


def polygon_mask(spans: DataFrame) -> DataFrame:
    """Covered pixels (region_id, y, x) of span rows."""
    return spans.select(
        "region_id", "y", F.explode(span(F.col("x0"), F.col("x1"))).alias("x")
    )


def in_region_table(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Add boolean ``selected`` from a mask (image_id, y, x) by equi join.

    The mask travels as words of 64 pixels of a line, made on the map side.
    """
    word, place = F.shiftright("x", 6), F.col("x").bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    words = mask.groupBy("image_id", "y", word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    hit = F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(bit) != 0
    return (
        pixels.withColumn("_word", word)
        .join(shuffled(words), ["image_id", "y", "_word"], "left")
        .withColumn("selected", hit)
        .select(*pixels.columns, "selected")
    )


def pick_pixels(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Pixels at (image_id, y, x), each once.

    Repeated requests are merged before the join, so a point asked for very
    often is no hot key; points outside their image have no row.
    """
    wanted = points.select("image_id", "y", "x").distinct()
    return pixels.join(wanted, ["image_id", "y", "x"], "left_semi").select(*pixels.columns)


def rescale(regions: DataFrame, dst_width, dst_height) -> DataFrame:
    """Carry boxes from an image of width x height to another size."""
    scaled = {}
    for c in ("x0", "x1"):
        scaled[c] = idiv(F.col(c) * dst_width, F.col("width")).cast("int")
    for c in ("y0", "y1"):
        scaled[c] = idiv(F.col(c) * dst_height, F.col("height")).cast("int")
    return regions.withColumns(scaled)
