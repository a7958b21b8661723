"""The pixel table, its invariants and the few expressions every module needs.

A collection of rasters is one DataFrame with a row per pixel::

    image_id BIGINT, width INT, height INT, y INT, x INT,
    a INT NULL, r INT, g INT, b INT

* Samples are 0..255. Gray rasters carry r = g = b, rasters without an alpha
  channel carry a NULL ``a``. Alpha 255 means fully transparent.
* Every image has exactly width x height rows, x in 0..width-1, y in 0..height-1.
* The size of the image travels with each row. Stored as Parquet it costs
  nothing (one run per image), and it makes crop, roll, flip, shear, scale and
  rotate plain projections: no join against an image catalogue.
* An image is at most 16383 x 16383, so a scan line or a column is a bounded
  group and may be a window partition. A whole image is never one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_SIDE = 16383
COLORS = ("r", "g", "b")
CHANNELS = ("a", "r", "g", "b")
PIXEL_COLUMNS = ("image_id", "width", "height", "y", "x", "a", "r", "g", "b")
PIXEL_SCHEMA = (
    "image_id BIGINT, width INT, height INT, y INT, x INT, a INT, r INT, g INT, b INT"
)

# A table is broadcast only when the caller can prove that rows times bytes per
# row stay below this.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 4096  # upper bound of a table row, unless the caller states another
SALTS = 32


class RasterArgumentError(ValueError):
    """Raised while a plan is built when an argument is out of its range."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise RasterArgumentError(message)


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", as_col(a), as_col(b))


def clamp8(value) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), as_col(value))).cast("int")


def span(lo, hi) -> Column:
    """Array lo..hi-1; NULL when empty, so that ``explode`` yields no row."""
    lo, hi = as_col(lo), as_col(hi)
    return F.when(hi > lo, F.sequence(lo, hi - 1))


def packed_rgb() -> Column:
    return (
        F.shiftleft(F.col("r"), 16)
        .bitwiseOR(F.shiftleft(F.col("g"), 8))
        .bitwiseOR(F.col("b"))
    )


def as_pixels(df: DataFrame) -> DataFrame:
    """Project to the canonical columns and types."""
    return df.select(
        F.col("image_id").cast("bigint"),
        *[F.col(c).cast("int") for c in PIXEL_COLUMNS[1:]],
    )


def heads(df: DataFrame) -> DataFrame:
    """One row per image: its top-left pixel. A narrow filter, no shuffle."""
    return df.where((F.col("y") == 0) & (F.col("x") == 0))


def row_heads(df: DataFrame) -> DataFrame:
    """One row per scan line: its leftmost pixel."""
    return df.where(F.col("x") == 0)


def is_small(rows: int | None, row_bytes: int = ROW_BYTES) -> bool:
    return rows is not None and rows * row_bytes <= BROADCAST_BYTES


def shuffled(table: DataFrame) -> DataFrame:
    """A join side that must not be broadcast.

    Size estimates don't count the rows that an explode adds or the memory a row
    takes, so a small file may hide a table too large for the driver.
    """
    return table.hint("merge")


def attach(
    pixels: DataFrame,
    table: DataFrame,
    how: str = "inner",
    rows: int | None = None,
    slot: Column | None = None,
    salts: int = SALTS,
    key: str = "image_id",
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Join a table with one row per image (or other ``key``) to the pixels.

    ``rows`` is a proven upper bound of the table (for example a catalogue
    count) and ``row_bytes`` one of its rows; a small table is broadcast. Otherwise it is a
    shuffled equi join on (key, slot): the rows of one image are dealt over
    ``salts`` slots (by scan line unless ``slot`` gives another number) and the
    table row is copied to each, so an image that holds a large share of all
    pixels does not land in one task.
    """
    columns = pixels.columns + [c for c in table.columns if c != key]
    if is_small(rows, row_bytes):
        return pixels.join(F.broadcast(table), key, how).select(*columns)
    slotted = shuffled(
        table.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    return (
        pixels.withColumn(
            "_slot", F.pmod(F.col("y") if slot is None else slot, F.lit(salts)).cast("int")
        )
        .join(slotted, [key, "_slot"], how)
        .select(*columns)
    )


def density(df: DataFrame) -> DataFrame:
    """Recount each image: rows present against width x height."""
    return (
        df.groupBy("image_id")
        .agg(
            F.max("width").alias("width"),
            F.max("height").alias("height"),
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("min_x"),
            F.min("y").alias("min_y"),
            (F.max("x") + 1).alias("seen_width"),
            (F.max("y") + 1).alias("seen_height"),
        )
        .withColumn(
            "dense",
            (F.col("n") == F.col("width").cast("bigint") * F.col("height"))
            & (F.col("seen_width") == F.col("width"))
            & (F.col("seen_height") == F.col("height"))
            & (F.col("min_x") == 0)
            & (F.col("min_y") == 0),
        )
    )
