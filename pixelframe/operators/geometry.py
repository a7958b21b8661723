"""Coordinate remaps.

A remap is written forward wherever the cells a source pixel lands on can be
computed from its own coordinates: then it is a projection (plus an explode)
and needs no shuffle. That covers crop, roll, flip, shift, shear, scaling,
canvas resizing and, since a rotation keeps distances, rotation as well. Cells
without a source are made from the first pixel of the image or of the line.
Only ``twirl`` gathers by an equi join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import (
    CHANNELS,
    COLORS,
    MAX_SIDE,
    PIXEL_COLUMNS,
    as_col,
    as_pixels,
    attach,
    heads,
    idiv,
    require,
    row_heads,
    span,
)


def _moved(df: DataFrame, **new: Column) -> DataFrame:
    """Re-address pixels; expressions see the old columns."""
    return as_pixels(df.select(*[new.get(c, F.col(c)).alias(c) for c in PIXEL_COLUMNS]))


def _colored(df: DataFrame, fill: dict[str, Column]) -> dict[str, Column]:
    return {c: fill[c] if c in fill else F.col(c) for c in CHANNELS}


def black() -> dict[str, Column]:
    """Zero in every component; a missing alpha stays missing."""
    zero = F.lit(0)
    return {"a": F.when(F.col("a").isNotNull(), zero), "r": zero, "g": zero, "b": zero}


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Keep a box and make its corner the origin."""
    require(0 <= x0 < x1 and 0 <= y0 < y1, "the box is not empty")
    kept = df.where(
        (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    )
    return _moved(
        kept,
        x=F.col("x") - x0,
        y=F.col("y") - y0,
        width=F.least(F.lit(x1), F.col("width")) - x0,
        height=F.least(F.lit(y1), F.col("height")) - y0,
    )


def autocrop(
    df: DataFrame, x_margin: int = 0, y_margin: int = 0, rows: int | None = None
) -> DataFrame:
    """Crop to the content; margins in the corner colour.

    Lines of the vertical margin that exist in the source are reused. Images of
    one colour are returned unchanged.
    """
    from .stats import content_bbox, corner_pixel

    box = content_bbox(df, rows).join(corner_pixel(df), "image_id")
    joined = attach(df, box, how="left", rows=rows)
    flat = joined.where(F.col("x0").isNull()).select(*PIXEL_COLUMNS)
    boxed = joined.where(F.col("x0").isNotNull())
    new_w = F.col("x1") - F.col("x0") + 2 * x_margin
    new_h = F.col("y1") - F.col("y0") + 2 * y_margin
    top = F.col("y0") - y_margin
    content = _moved(
        boxed.where(
            (F.col("x") >= F.col("x0"))
            & (F.col("x") < F.col("x1"))
            & (F.col("y") >= top)
            & (F.col("y") < F.col("y1") + y_margin)
        ),
        x=F.col("x") - F.col("x0") + x_margin,
        y=F.col("y") - top,
        width=new_w,
        height=new_h,
    )
    # margin cells come from the image head: two side strips on every line, and
    # whole lines where the source has none
    first = heads(df).select("image_id", "height", "a").join(box, "image_id")
    lines = first.select("*", F.explode(span(F.lit(0), new_h)).alias("line")).repartition("image_id", "line")
    outside = (F.col("line") + top < 0) | (F.col("line") + top >= F.col("height"))
    inner = F.when(outside, span(F.lit(x_margin), new_w - x_margin))
    cells = F.flatten(
        F.array_compact(
            F.array(span(F.lit(0), F.lit(x_margin)), inner, span(new_w - x_margin, new_w))
        )
    )
    margin = lines.select(
        "image_id",
        new_w.alias("width"),
        new_h.alias("height"),
        F.col("line").alias("y"),
        F.explode(cells).alias("x"),
        "a",
        *[F.col(f"_c{c}").alias(c) for c in COLORS],
    )
    return content.unionByName(as_pixels(margin)).unionByName(flat)


def resize_canvas(
    df: DataFrame, new_width: int, new_height: int, fill: str = "black"
) -> DataFrame:
    """Enlarge the canvas with the image centred; never shrinks.

    fill: black, white, background (corner average) or border (edge pixels
    repeated outward).
    """
    require(fill in ("black", "white", "background", "border"), f"unknown fill {fill}")
    require(1 <= new_width <= MAX_SIDE and 1 <= new_height <= MAX_SIDE, "size out of range")
    w = F.greatest(F.lit(new_width), F.col("width"))
    h = F.greatest(F.lit(new_height), F.col("height"))
    left = idiv(w - F.col("width"), 2).cast("int")
    top = idiv(h - F.col("height"), 2).cast("int")
    last_x, last_y = F.col("width") - 1, F.col("height") - 1
    if fill == "border":
        # an edge pixel covers its own cell and everything outward of it
        def cover(at: Column, last: Column, offset: Column, size: Column) -> Column:
            lo = F.when(at == 0, F.lit(0)).otherwise(at + offset)
            hi = F.when(at == last, size).otherwise(at + offset + 1)
            return F.explode(span(lo, hi))

        spread = df.withColumns({"_w": w, "_h": h, "_l": left, "_t": top})
        spread = spread.withColumn(
            "_x", cover(F.col("x"), last_x, F.col("_l"), F.col("_w"))
        ).withColumn("_y", cover(F.col("y"), last_y, F.col("_t"), F.col("_h")))
        return _moved(
            spread, x=F.col("_x"), y=F.col("_y"), width=F.col("_w"), height=F.col("_h")
        )
    inside = _moved(df, x=F.col("x") + left, y=F.col("y") + top, width=w, height=h)
    if fill == "background":
        from .stats import background_color

        first = heads(df).drop(*COLORS).join(background_color(df), "image_id")
        paint = _colored(df, {})
    else:
        first = heads(df)
        value = F.lit(0 if fill == "black" else 255)
        paint = {c: value for c in COLORS}
        paint["a"] = F.when(F.col("a").isNotNull(), value)
    return inside.unionByName(
        _outside_cells(first, w, h, left, top, F.col("width"), F.col("height"), paint)
    )


def _outside_cells(
    first: DataFrame,
    w: Column,
    h: Column,
    left: Column,
    top: Column,
    inner_w: Column,
    inner_h: Column,
    paint: dict[str, Column],
) -> DataFrame:
    """Cells of a w x h canvas not covered by the inner box at (left, top).

    Lines are dealt over the tasks before their cells are made.
    """
    lines = first.select(
        "image_id",
        w.alias("_w"),
        h.alias("_h"),
        left.alias("_l"),
        top.alias("_t"),
        inner_w.alias("_iw"),
        inner_h.alias("_ih"),
        *[paint[c].alias(c) for c in CHANNELS],
    ).withColumn("y", F.explode(span(F.lit(0), F.col("_h")))).repartition("image_id", "y")
    in_rows = (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_t") + F.col("_ih"))
    sides = F.flatten(
        F.array_compact(
            F.array(
                span(F.lit(0), F.col("_l")), span(F.col("_l") + F.col("_iw"), F.col("_w"))
            )
        )
    )
    xs = F.when(in_rows, sides).otherwise(span(F.lit(0), F.col("_w")))
    cells = lines.withColumn("x", F.explode(xs))
    return as_pixels(
        cells.withColumnsRenamed({"_w": "width", "_h": "height"}).select(*PIXEL_COLUMNS)
    )


def shift(df: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """Translate inside the same canvas; vacated cells become 0."""
    w, h = F.col("width"), F.col("height")
    x, y = F.col("x") + dx, F.col("y") + dy
    kept = _moved(df.where((x >= 0) & (x < w) & (y >= 0) & (y < h)), x=x, y=y)
    left = F.greatest(F.lit(0), F.least(w, F.lit(dx)))
    top = F.greatest(F.lit(0), F.least(h, F.lit(dy)))
    inner_w = F.greatest(F.lit(0), w - abs(dx))
    inner_h = F.greatest(F.lit(0), h - abs(dy))
    return kept.unionByName(_outside_cells(heads(df), w, h, left, top, inner_w, inner_h, black()))


def roll(df: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """Translate modulo the size. A projection."""
    return _moved(
        df,
        x=F.pmod(F.col("x") + dx, F.col("width")),
        y=F.pmod(F.col("y") + dy, F.col("height")),
    )


def _mirrored(name: str, size: str, lo: int | None, hi: int | None) -> Column:
    at = F.col(name)
    if lo is None:
        return F.col(size) - 1 - at
    end = F.least(F.lit(hi), F.col(size))
    return lo + end - 1 - at


def flip_x(df: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Mirror left-right, inside the box if one is given."""
    return _flip(df, "x", "width", box)


def flip_y(df: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Mirror top-bottom, inside the box if one is given."""
    return _flip(df, "y", "height", box)


def _flip(df: DataFrame, name: str, size: str, box) -> DataFrame:
    from .regions import rect

    if box is None:
        return _moved(df, **{name: _mirrored(name, size, None, None)})
    lo, hi = (box[0], box[2]) if name == "x" else (box[1], box[3])
    new = F.when(rect(*box), _mirrored(name, size, lo, hi)).otherwise(F.col(name))
    return _moved(df, **{name: new})


def shear_amount(angle: int, size: Column) -> Column:
    """Whole pixels of slant over ``size``; the tangent is a literal."""
    require(-89 <= angle <= 89, "shear angle lies in -89..89")
    return (F.lit(math.tan(math.pi * angle / 180.0)) * size).cast("int")


def shear_h(df: DataFrame, angle: int) -> DataFrame:
    """Slide each line sideways in proportion to its height; fill with 0."""
    n = shear_amount(angle, F.col("height"))
    start = F.when(n < 0, F.lit(0)).otherwise(n)

    def offset(y: Column) -> Column:
        return start - idiv(n * y, F.col("height"))

    w = F.col("width") + F.abs(n)
    inside = _moved(df, x=F.col("x") + offset(F.col("y")), width=w)
    # each line's first pixel knows the vacated cells of its line
    gaps = F.flatten(
        F.array_compact(
            F.array(
                span(F.lit(0), offset(F.col("y"))),
                span(offset(F.col("y")) + F.col("width"), w),
            )
        )
    )
    fill = row_heads(df).withColumns({**black(), "_x": F.explode(gaps)})
    return inside.unionByName(_moved(fill, x=F.col("_x"), width=w))


def shear_v(df: DataFrame, angle: int) -> DataFrame:
    """Slide each column; for negative angles the slope runs from the right."""
    n = shear_amount(angle, F.col("width"))
    col = F.when(n < 0, F.col("width") - 1 - F.col("x")).otherwise(F.col("x"))
    offset = idiv(F.abs(n) * col, F.col("width"))
    h = F.col("height") + F.abs(n)
    inside = _moved(df, y=F.col("y") + offset, height=h)
    gaps = F.flatten(
        F.array_compact(F.array(span(F.lit(0), offset), span(offset + F.col("height"), h)))
    )
    fill = df.where(F.col("y") == 0).withColumns({**black(), "_y": F.explode(gaps)})
    return inside.unionByName(_moved(fill, y=F.col("_y"), height=h))


class Rotation:
    """Expressions of one rotation: new size and the inverse map."""

    def __init__(self, angle: int):
        require(-180 <= angle <= 180, "rotation angle lies in -180..180")
        turn = math.pi * angle / 180.0
        self.cos, self.sin = math.cos(turn), math.sin(turn)
        self.steep = 0 <= angle <= 90 or angle < -90

    def size(self) -> tuple[Column, Column]:
        w, h = F.col("width").cast("double"), F.col("height").cast("double")
        c, s = F.lit(self.cos), F.lit(self.sin)
        if self.steep:
            new_w = F.abs(w * c) + F.abs(h * s)
            new_h = F.abs(w * s + h * c)
        else:
            new_w = F.abs(w * c - h * s)
            new_h = F.abs(w * s) + F.abs(h * c)
        return F.floor(new_w + 0.5).cast("int"), F.floor(new_h + 0.5).cast("int")

    def centre(self, w: Column, h: Column) -> tuple[Column, Column]:
        return (w - 1) / F.lit(2.0), (h - 1) / F.lit(2.0)

    def inverse(self, dx: Column, dy: Column, old, new) -> tuple[Column, Column]:
        """Source position of destination cell (dx, dy)."""
        u, v = dx - new[0], dy - new[1]
        return (
            u * self.cos + v * self.sin + old[0],
            v * self.cos - u * self.sin + old[1],
        )

    def forward(self, x: Column, y: Column, old, new) -> tuple[Column, Column]:
        u, v = x - old[0], y - old[1]
        return (
            u * self.cos - v * self.sin + new[0],
            u * self.sin + v * self.cos + new[1],
        )


def _inside(sx: Column, sy: Column) -> Column:
    return (
        (sx >= -0.49)
        & (sy >= -0.49)
        & (sx <= F.col("width") - 1)
        & (sy <= F.col("height") - 1)
    )


def _rotated_candidates(df: DataFrame, turn: Rotation) -> DataFrame:
    """Each pixel with the destination cells that may read it, and their source.

    A reading cell has its source less than 1 away on each axis, so it lies less
    than 1.42 from the pixel's own image: one cell around the rounded position.
    """
    new_w, new_h = turn.size()
    sized = df.withColumns({"_nw": new_w, "_nh": new_h})
    old = turn.centre(F.col("width"), F.col("height"))
    new = turn.centre(F.col("_nw"), F.col("_nh"))
    fx, fy = turn.forward(F.col("x"), F.col("y"), old, new)
    at = sized.withColumns({"_fx": F.floor(fx + 0.5).cast("int"), "_fy": F.floor(fy + 0.5).cast("int")})
    window = F.lit([-1, 0, 1])
    cells = (
        at.withColumn("_j", F.explode(window))
        .withColumn("_dy", F.col("_fy") + F.col("_j"))
        .where((F.col("_dy") >= 0) & (F.col("_dy") < F.col("_nh")))
        .withColumn("_i", F.explode(window))
        .withColumn("_dx", F.col("_fx") + F.col("_i"))
        .where((F.col("_dx") >= 0) & (F.col("_dx") < F.col("_nw")))
    )
    sx, sy = turn.inverse(F.col("_dx"), F.col("_dy"), old, new)
    return cells.withColumns({"_sx": sx, "_sy": sy}).where(_inside(F.col("_sx"), F.col("_sy")))


def _rotated_blank(df: DataFrame, turn: Rotation) -> DataFrame:
    """Destination cells that read outside the source."""
    new_w, new_h = turn.size()
    old = turn.centre(F.col("width"), F.col("height"))
    new = turn.centre(F.col("_nw"), F.col("_nh"))
    cells = (
        heads(df)
        .withColumns({**black(), "_nw": new_w, "_nh": new_h})
        .withColumn("_dy", F.explode(span(F.lit(0), F.col("_nh"))))
        .repartition("image_id", "_dy")
        .withColumn("_dx", F.explode(span(F.lit(0), F.col("_nw"))))
    )
    sx, sy = turn.inverse(F.col("_dx"), F.col("_dy"), old, new)
    outside = cells.withColumns({"_sx": sx, "_sy": sy}).where(~_inside(F.col("_sx"), F.col("_sy")))
    return _moved(
        outside, x=F.col("_dx"), y=F.col("_dy"), width=F.col("_nw"), height=F.col("_nh")
    )


def rotate_nn(df: DataFrame, angle: int) -> DataFrame:
    """Rotate about the centre, nearest source pixel, canvas grows, outside 0.

    A cell whose nearest source is this pixel lies within 0.71 of the pixel's
    image, so nine candidate cells per pixel are enough and nothing is shuffled.
    """
    turn = Rotation(angle)
    cells = _rotated_candidates(df, turn).where(
        (F.floor(F.col("_sx") + 0.5) == F.col("x")) & (F.floor(F.col("_sy") + 0.5) == F.col("y"))
    )
    placed = _moved(
        cells, x=F.col("_dx"), y=F.col("_dy"), width=F.col("_nw"), height=F.col("_nh")
    )
    return placed.unionByName(_rotated_blank(df, turn))


def _tap(at: str, pixel: str) -> Column:
    """Weight in 1/256 of a pixel for a position given in 1/256 steps."""
    return F.greatest(F.lit(0), 256 - F.abs(F.col(at) - F.col(pixel) * 256))


def rotate_bilinear(df: DataFrame, angle: int) -> DataFrame:
    """As ``rotate_nn`` with the four neighbours weighted in 1/256 steps.

    Integer weights make the sums independent of their order. One aggregation.
    """
    turn = Rotation(angle)
    # positions left of pixel 0 read pixel 0 alone
    steps = {
        c: F.greatest(F.lit(0), F.floor(F.col(c) * 256).cast("int")) for c in ("_sx", "_sy")
    }
    cells = (
        _rotated_candidates(df, turn)
        .withColumns(steps)
        .withColumn("_k", _tap("_sx", "x") * _tap("_sy", "y"))
    )
    return _weighted(cells.where("_k > 0")).unionByName(_rotated_blank(df, turn))


def _weighted(cells: DataFrame) -> DataFrame:
    """Sum of channel * _k / 65536 per destination cell."""
    sums = {c: F.shiftright(F.sum(F.col(c).cast("bigint") * F.col("_k")), 16) for c in CHANNELS}
    out = cells.groupBy("image_id", F.col("_dy").alias("y"), F.col("_dx").alias("x")).agg(
        F.max("_nw").alias("width"),
        F.max("_nh").alias("height"),
        *[v.alias(c) for c, v in sums.items()],
    )
    return as_pixels(out)


def _twirled(df: DataFrame, angle: int, radius: int, cx: int, cy: int):
    """Split into (cells to compute with their source position, untouched cells)."""
    require(radius >= 1, "radius is positive")
    dx, dy = (F.col("x") - cx).cast("double"), (F.col("y") - cy).cast("double")
    distance = F.sqrt(dx * dx + dy * dy)
    turn = F.lit(math.pi * angle / 180.0) * (1.0 - distance / radius)
    inside = df.where(distance < radius)
    # positions on a 1/4096 grid: engines may differ in the last bit of sin
    sx = F.floor((dx * F.cos(turn) + dy * F.sin(turn) + cx) * 4096 + 0.5) / 4096
    sy = F.floor((dy * F.cos(turn) - dx * F.sin(turn) + cy) * 4096 + 0.5) / 4096
    return inside.withColumns({"_sx": sx, "_sy": sy}), df.where(distance >= radius)


def _source_disc(df: DataFrame, radius: int, cx: int, cy: int) -> DataFrame:
    """Source pixels a twirl can read: its disc plus two pixels."""
    reach = radius + 2
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return df.where(dx * dx + dy * dy <= reach * reach).select(
        "image_id",
        F.col("y").alias("_qy"),
        F.col("x").alias("_qx"),
        *[F.col(c).alias(f"q_{c}") for c in CHANNELS],
    )


def twirl_nn(df: DataFrame, angle: int, radius: int, cx: int, cy: int) -> DataFrame:
    """Rotate by angle * (1 - d / radius) inside the disc; outside unchanged."""
    cells, rest = _twirled(df, angle, radius, cx, cy)
    valid = _inside(F.col("_sx"), F.col("_sy"))
    zero = _moved(cells.where(~valid), **black())
    wanted = cells.where(valid).withColumns(
        {
            "_qx": F.floor(F.col("_sx") + 0.5).cast("int"),
            "_qy": F.floor(F.col("_sy") + 0.5).cast("int"),
        }
    )
    read = wanted.join(
        _source_disc(df, radius, cx, cy), ["image_id", "_qy", "_qx"], "left"
    )
    new = {c: F.coalesce(F.col(f"q_{c}"), F.lit(0)) for c in COLORS}
    new["a"] = F.when(F.col("a").isNotNull(), F.coalesce(F.col("q_a"), F.lit(0)))
    return _moved(read, **new).unionByName(zero).unionByName(as_pixels(rest))


def twirl_bilinear(df: DataFrame, angle: int, radius: int, cx: int, cy: int) -> DataFrame:
    """As ``twirl_nn`` with four weighted neighbours."""
    cells, rest = _twirled(df, angle, radius, cx, cy)
    valid = _inside(F.col("_sx"), F.col("_sy"))
    zero = _moved(cells.where(~valid), **black())
    base_x, base_y = F.floor("_sx"), F.floor("_sy")
    part_x = F.floor((F.col("_sx") - base_x) * 256).cast("int")
    part_y = F.floor((F.col("_sy") - base_y) * 256).cast("int")
    edge_x = lambda v: F.greatest(F.lit(0), F.least(F.col("width") - 1, v)).cast("int")
    edge_y = lambda v: F.greatest(F.lit(0), F.least(F.col("height") - 1, v)).cast("int")
    taps = F.array(
        *[
            F.struct(
                edge_y(base_y + j).alias("qy"),
                edge_x(base_x + i).alias("qx"),
                (
                    (part_y if j else 256 - part_y) * (part_x if i else 256 - part_x)
                ).alias("k"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    wanted = (
        cells.where(valid)
        .select(
            "image_id",
            F.col("width").alias("_nw"),
            F.col("height").alias("_nh"),
            F.col("y").alias("_dy"),
            F.col("x").alias("_dx"),
            F.explode(taps).alias("t"),
        )
        .select(
            "*", F.col("t.qy").alias("_qy"), F.col("t.qx").alias("_qx"), F.col("t.k").alias("_k")
        )
        .where(F.col("_k") > 0)
    )
    read = wanted.join(_source_disc(df, radius, cx, cy), ["image_id", "_qy", "_qx"])
    summed = _weighted(read.withColumnsRenamed({f"q_{c}": c for c in CHANNELS}))
    return summed.unionByName(zero).unionByName(as_pixels(rest))


def covered(at: Column, size: Column, new: Column) -> Column:
    """Destination indexes j with j * size div new == at; NULL if there are none."""
    lo = idiv(at * new + size - 1, size)
    hi = idiv((at + 1) * new + size - 1, size)
    return span(lo.cast("int"), hi.cast("int"))


def scale_quick(df: DataFrame, new_width, new_height) -> DataFrame:
    """Nearest by integer ratio. Each pixel is copied to the cells it covers."""
    w, h = as_col(new_width), as_col(new_height)
    spread = df.withColumn("_y", F.explode(covered(F.col("y"), F.col("height"), h))).withColumn(
        "_x", F.explode(covered(F.col("x"), F.col("width"), w))
    )
    return _moved(spread, x=F.col("_x"), y=F.col("_y"), width=w, height=h)


def thumbnail(df: DataFrame, width: int, height: int) -> DataFrame:
    """Small copy of each image for previews."""
    require(1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE, "size out of range")
    return scale_quick(df, width, height)


FIXED_ONE = 4096


def _averaged(df: DataFrame, axis: str, size: str, new: int) -> DataFrame:
    """One pass of area weighting along an axis, in steps of 1/one.

    Source line i covers [i*s, (i+1)*s) with s = new*one div old, destination
    line j covers [j*one, (j+1)*one); the weight is the overlap, and what is
    missing at the end goes to the last source line. one is 4096; beyond 4096 old
    lines to a new one, where s would be 0, it is 2^28.
    """
    other, other_size = ("x", "width") if axis == "y" else ("y", "height")
    one = F.when(F.col(size) > new * FIXED_ONE, F.lit(1 << 28)).otherwise(F.lit(FIXED_ONE)).cast("bigint")
    step = idiv(one * new, F.col(size))
    lo = F.col(axis) * step
    last = F.col(axis) == F.col(size) - 1
    hi = F.when(last, one * new).otherwise(lo + step)
    ranged = df.withColumns({"_lo": lo, "_hi": hi, "_one": one})
    one = F.col("_one")
    cells = ranged.withColumn(
        "_j",
        F.explode(
            span(idiv(F.col("_lo"), one), idiv(F.col("_hi") + one - 1, one))
        ),
    )
    begin = F.greatest(F.col("_lo"), F.col("_j") * one)
    end = F.least(F.col("_hi"), (F.col("_j") + 1) * one)
    weighed = cells.withColumn("_k", end - begin)
    value = lambda c: F.least(
        F.lit(255), idiv(F.sum(F.col(c) * F.col("_k")) + F.expr("max(_one) div 2"), F.max(one))
    )
    summed = weighed.groupBy(
        "image_id", F.col("_j").cast("int").alias(axis), other, other_size
    ).agg(*[F.when(F.count(c) > 0, value(c)).alias(c) for c in CHANNELS])
    return as_pixels(summed.withColumn(size, F.lit(new)))


def scale_average(df: DataFrame, new_width: int, new_height: int) -> DataFrame:
    """Area-weighted scaling, lines first, then columns, rounded at each pass."""
    require(1 <= new_width <= MAX_SIDE and 1 <= new_height <= MAX_SIDE, "size out of range")
    return _averaged(_averaged(df, "y", "height", new_height), "x", "width", new_width)


def scale_units(
    images: DataFrame,
    percent: tuple[float, float] | None = None,
    millimetres: tuple[float, float] | None = None,
    keep_aspect: bool = False,
) -> DataFrame:
    """Target sizes in pixels, percent and millimetres for catalogue rows.

    ``images`` has image_id, width, height, dpi_x, dpi_y. With ``keep_aspect``
    the height follows the width.
    """
    require((percent is None) != (millimetres is None), "give one of the two units")
    if percent is not None:
        w = F.floor(F.lit(float(percent[0])) * F.col("width") / 100.0)
        h = F.floor(F.lit(float(percent[1])) * F.col("height") / 100.0)
    else:
        w = F.floor(F.col("dpi_x") * F.lit(float(millimetres[0])) / 2.54)
        h = F.floor(F.col("dpi_y") * F.lit(float(millimetres[1])) / 2.54)
    if keep_aspect:
        h = idiv(w * F.col("height"), F.col("width"))
    sized = images.withColumns({"new_width": w.cast("int"), "new_height": h.cast("int")})
    return sized.withColumns(
        {
            "percent_x": F.lit(100.0) * F.col("new_width") / F.col("width"),
            "percent_y": F.lit(100.0) * F.col("new_height") / F.col("height"),
            "mm_x": F.lit(2.54) * F.col("new_width") / F.col("dpi_x"),
            "mm_y": F.lit(2.54) * F.col("new_height") / F.col("dpi_y"),
        }
    )
