"""Image files: ingest by Spark's image source, format sniffing, Parquet sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..layout import COLORS, PIXEL_SCHEMA, require, span
from .images import discard, exists, qualified, settle, staged

# File name suffixes and leading bytes, tried in this order.
SUFFIXES = [
    ("bmp", "bmp"),
    ("gif|gif89", "gif"),
    ("iff|ilbm|lbm", "ilbm"),
    ("jpg|jpeg|jfif", "jpeg"),
    ("png", "png"),
    ("ppm|pgm|pnm", "ppm"),
    ("pic", "pic"),
    ("tga|targa", "targa"),
    ("tif|tiff", "tiff"),
    ("yuv|yuvn|vlab", "yuvn"),
]
SIGNATURES = [
    ("424D", "bmp"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("FFD8", "jpeg"),
    ("89504E470D0A1A0A", "png"),
    ("5032", "ppm"),
    ("5033", "ppm"),
    ("5035", "ppm"),
    ("5036", "ppm"),
    ("504943DC", "pic"),
    ("4949", "tiff"),
    ("4D4D", "tiff"),
]


def sniff_format(path: Column, content: Column) -> Column:
    """Format name from the suffix, else from the first 16 bytes, else NULL."""
    start = F.hex(F.substring(content, 1, 16))
    lower = F.lower(path)
    chain = F
    for suffix, name in SUFFIXES:
        chain = chain.when(lower.rlike(rf"\.({suffix})$"), F.lit(name))
    for magic, name in SIGNATURES:
        chain = chain.when(start.startswith(magic), F.lit(name))
    return chain


def sniff_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, format) of the files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    return found.select(
        "path", "length", sniff_format(F.col("path"), F.col("content")).alias("format")
    )


def load_images(
    spark: SparkSession,
    path: str,
    image_id: Callable[[Column], Column] | None = None,
    invalid: str = "skip",
) -> DataFrame:
    """Decode image files to pixels.

    Files that cannot be decoded have no pixels; ``rejected_images`` lists them, and
    with ``invalid="raise"`` the first one is an error.

    ``image_id`` makes the number of an image from its path; the default is a
    63-bit hash.

    The built-in source delivers interleaved B,G,R[,A] bytes. Its alpha is an
    opacity, ours a transparency. Images are cut into scan lines in the JVM, so
    what travels to Python in one row is a line, never a whole image.
    """
    require(invalid in ("raise", "skip"), "invalid is raise or skip")
    raw = _image_source(spark, path)
    origin = F.col("origin")
    if invalid == "raise":
        stop = F.raise_error(F.concat(F.lit("cannot decode "), origin))
        raw = raw.withColumn("height", F.when(_decoded(), F.col("height")).otherwise(stop.cast("int")))
    number = image_id(origin) if image_id else F.xxhash64(origin).bitwiseAND(F.lit(2**63 - 1))
    keyed = raw.select(
        number.cast("bigint").alias("image_id"),
        "width",
        "height",
        F.col("nChannels").alias("n"),
        "data",
    )
    size = F.col("width") * F.col("n")
    lines = keyed.withColumn("y", F.explode(span(F.lit(0), F.col("height")))).select(
        "image_id",
        "width",
        "height",
        "y",
        "n",
        F.substring(F.col("data"), F.col("y") * size + 1, size).alias("line"),
    )
    return lines.mapInArrow(_decode_lines, PIXEL_SCHEMA)


def _image_source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder and of all folders in it."""
    reader = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    return reader.load(path).select("image.*")


def _decoded() -> Column:
    return (F.col("width") > 0) & (F.col("height") > 0)


def rejected_images(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files under a folder that cannot be decoded."""
    raw = _image_source(spark, path)
    return raw.where(~_decoded()).select(F.col("origin").alias("path"))


PIXELS_PER_BATCH = 500_000


def _decode_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan lines of interleaved bytes to pixel rows, a bounded batch at a time."""
    names = [field.split()[0] for field in PIXEL_SCHEMA.split(", ")]
    types = [pa.int64()] + [pa.int32()] * (len(names) - 1)
    held: list[list] = []
    size = 0

    def emit() -> pa.RecordBatch:
        columns = [pa.concat_arrays(parts) for parts in zip(*held)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for row in batch.to_pylist():
            w, n = row["width"], row["n"]
            cell = np.frombuffer(row["line"], dtype=np.uint8).reshape(w, n).astype(np.int32)
            blue, green, red = (cell[:, i if n >= 3 else 0] for i in range(3))
            values = [
                np.full(w, row["image_id"]),
                np.full(w, w),
                np.full(w, row["height"]),
                np.full(w, row["y"]),
                np.arange(w),
                255 - cell[:, 3] if n == 4 else None,
                red,
                green,
                blue,
            ]
            held.append(
                [pa.nulls(w, t) if v is None else pa.array(v, t) for v, t in zip(values, types)]
            )
            size += w
            if size >= PIXELS_PER_BATCH:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def to_strips(df: DataFrame) -> DataFrame:
    """One row per scan line with SMALLINT arrays; a line is a bounded group."""
    cell = F.struct("x", *[F.col(c).cast("smallint").alias(c) for c in ("a", *COLORS)])
    lines = df.groupBy("image_id", "width", "height", "y").agg(
        F.sort_array(F.collect_list(cell)).alias("cells")
    )
    return lines.select(
        "image_id", "width", "height", "y", *[F.col(f"cells.{c}").alias(c) for c in ("a", *COLORS)]
    )


def from_strips(strips: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(*[F.col(c) for c in ("a", *COLORS)])
    cells = strips.select("image_id", "width", "height", "y", F.posexplode(zipped).alias("x", "s"))
    return cells.select(
        "image_id",
        "width",
        "height",
        "y",
        "x",
        *[F.col(f"s.{c}").cast("int").alias(c) for c in ("a", *COLORS)],
    )


def save_truecolor(
    df: DataFrame,
    path: str,
    colorspaces: DataFrame | None = None,
    accepts: tuple[str, ...] = ("GRAY", "RGB", "ARGB"),
    overwrite: bool = False,
) -> None:
    """Write rasters as Parquet clustered by image and line.

    Refuses colour spaces the target does not accept, fails if the path exists
    unless told to overwrite; a failed job leaves no files (commit protocol).
    Range partitioning on (image_id, y) splits a large image over many files
    and gives each file tight statistics for pruning.
    """
    if colorspaces is not None:
        refused = colorspaces.where(~F.col("colorspace").isin(*accepts)).limit(1).count()
        require(refused == 0, "a colour space is not supported by this sink")
    ordered = df.repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y", "x")
    ordered.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_indexed(
    indexed: DataFrame, palettes: DataFrame, path: str, overwrite: bool = False
) -> None:
    """Write pens and palettes of rendered rasters side by side, with one commit.

    Both tables are written into a staging folder beside the path, which then gets the
    path's name; a failure of either leaves nothing, and what is overwritten goes last.
    """
    path = qualified(indexed.sparkSession, path)
    require(overwrite or not exists(path), f"{path} exists")
    stage = staged(path)
    try:
        palettes.write.parquet(f"{stage}/palettes")
        ordered = indexed.repartitionByRange("image_id", "y").sortWithinPartitions("image_id", "y", "x")
        ordered.write.parquet(f"{stage}/indexed_pixels")
        settle(stage, path, overwrite)
    except BaseException:
        discard(stage)
        raise
