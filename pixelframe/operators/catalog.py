"""Catalogue tables: frames, colour spaces, named attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import SALTS, idiv, shuffled

# Bit of each colour space in an accepts-mask.
COLORSPACE_BITS = {"GRAY": 1, "RGB": 2, "LUT": 4, "ARGB": 8}
COMPONENTS = {"GRAY": 1, "RGB": 3, "LUT": 1, "ARGB": 4}
ATTR_KINDS = ("PRIVATE", "CSTRING", "LONG", "FLOAT")


def _by_space(values: dict, space: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(space == name, F.lit(value))
    return chain


def frame_info(df: DataFrame) -> DataFrame:
    """Properties recomputed from pixels: size, colour space, bytes per row."""
    gray = F.min((F.col("r") == F.col("g")) & (F.col("g") == F.col("b")))
    found = df.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
        F.when(F.count("a") > 0, "ARGB").when(gray, "GRAY").otherwise("RGB").alias("colorspace"),
        F.count(F.lit(1)).alias("pixels"),
    )
    components = _by_space(COMPONENTS, F.col("colorspace"))
    return found.withColumn(
        "bytes_per_row", idiv(F.col("pixels") * components, F.col("height"))
    )


def colorspace_names(mask: Column) -> Column:
    """Names of the colour spaces in an accepts-mask, in bit order."""
    names = [
        F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
        for name, bit in COLORSPACE_BITS.items()
    ]
    return F.concat_ws(",", *names)


def colorspace_guard(images: DataFrame, accepts: Column | int) -> DataFrame:
    """Images whose colour space the operator does not accept."""
    mask = accepts if isinstance(accepts, Column) else F.lit(accepts)
    bit = F.coalesce(_by_space(COLORSPACE_BITS, F.col("colorspace")), F.lit(0))
    return images.where(bit.bitwiseAND(mask) == 0)


def copy_frame(images: DataFrame, source_ids: DataFrame, offset: int) -> DataFrame:
    """Duplicate frames under new numbers; the copy remembers its parent."""
    copies = images.join(source_ids, "image_id", "left_semi").select(
        (F.col("image_id") + offset).alias("image_id"),
        *[c for c in images.columns if c not in ("image_id", "parent_id")],
        F.col("image_id").alias("parent_id"),
    )
    base = images if "parent_id" in images.columns else images.withColumn(
        "parent_id", F.lit(None).cast("bigint")
    )
    return base.unionByName(copies)


def rename_frame(images: DataFrame, names: DataFrame) -> DataFrame:
    """New names from (image_id, new_name); at most one per frame."""
    return images.join(names, "image_id", "left").withColumn(
        "name", F.coalesce("new_name", "name")
    ).drop("new_name")


def delete_frame(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop frames from the catalogue, or from the pixel table by line slots."""
    doomed = ids.select("image_id").distinct()
    if "y" not in df.columns:
        return df.join(doomed, "image_id", "left_anti")
    slotted = doomed.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = df.withColumn("_slot", F.pmod(F.col("y"), F.lit(SALTS)).cast("int"))
    return kept.join(shuffled(slotted), ["image_id", "_slot"], "left_anti").select(*df.columns)


def find_frame(images: DataFrame, name: str | DataFrame) -> DataFrame:
    """Frames of a name, or of any name in a table with a column ``name``."""
    if isinstance(name, DataFrame):
        return images.join(name.select("name").distinct(), "name", "left_semi").select(*images.columns)
    return images.where(F.col("name") == name)


def set_attr(attrs: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert (image_id, name, ..., seq): the highest seq of a name wins.

    ``max_by`` aggregates on the map side, so a name written very often does
    not collect its history in one task.
    """
    merged = attrs.unionByName(changes)
    values = [c for c in merged.columns if c not in ("image_id", "name")]
    last = merged.groupBy("image_id", "name").agg(
        F.max_by(F.struct(*values), "seq").alias("v")
    )
    return last.select("image_id", "name", *[F.col(f"v.{c}").alias(c) for c in values])


def find_attr(attrs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up (image_id, name); names are case-sensitive."""
    return wanted.join(attrs, ["image_id", "name"], "left")


def remove_attr(attrs: DataFrame, doomed: DataFrame) -> DataFrame:
    return attrs.join(doomed.select("image_id", "name"), ["image_id", "name"], "left_anti")


def attr_map(attrs: DataFrame) -> DataFrame:
    """One row per image: MAP of name to text value (names of one image only)."""
    text = F.coalesce(
        "v_str", F.col("v_long").cast("string"), F.col("v_float").cast("string")
    )
    return attrs.groupBy("image_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", text.alias("value"))))).alias(
            "attrs"
        )
    )


def escape_attr(text: Column) -> Column:
    """One-line form: backslash doubled, newline as \\n."""
    return F.replace(
        F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")
    )


def unescape_attr(text: Column) -> Column:
    """Inverse of ``escape_attr``; an escaped r and a lone backslash are dropped.

    Doubled backslashes are parked on a control character so that the n after
    them is not taken for a newline.
    """
    parked = F.replace(text, F.lit("\\\\"), F.lit("\x01"))
    spaced = F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit(""))
    return F.replace(F.replace(spaced, F.lit("\\"), F.lit("")), F.lit("\x01"), F.lit("\\"))


def get_area(regions: DataFrame) -> DataFrame:
    """Boxes of regions as (region_id, x0, y0, width, height)."""
    return regions.select(
        "region_id",
        "x0",
        "y0",
        (F.col("x1") - F.col("x0")).alias("width"),
        (F.col("y1") - F.col("y0")).alias("height"),
    )
