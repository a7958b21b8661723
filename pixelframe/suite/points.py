"""Point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, noise, ordered, tone
from ..functions.samples import pack_argb, rescale_samples, unpack_argb, yuv_to_rgb
from ..operators import combine, regions, stats
from .core import (
    ARGB_SQL, GRAY_SQL, PLOT_SQL, RGB_SQL, argb, clamp_sql, each_sql, gray, plot,
    point_sql, query, rgb, rgb_images, shown, sql, sql_then,
)



def box():
    return regions.rect(4, 6, 28, 27)


BOX_SQL = "x >= 4 AND x < 28 AND y >= 6 AND y < 27"


def listed(table: list[int]) -> str:
    return "[" + ", ".join(map(str, table)) + "]"


def lut_sql(source: str, table: list[int], where: str = "") -> str:
    return each_sql(source, f"({listed(table)})[{{c}} + 1]", where=where)


@query("rescale_samples", sql(RGB_SQL, """
SELECT image_id, y, x, CAST((r * 255 + 499) // 999 AS INTEGER) AS r,
       CAST((g * 255 + 127) // 255 AS INTEGER) AS g,
       CAST((b * 255 + 510) // 1021 AS INTEGER) AS b FROM px"""))
def _(spark, d):
    df = rgb(spark, d)
    return shown(df.withColumns({
        "r": rescale_samples(F.col("r"), 999),
        "g": rescale_samples(F.col("g"), 255),
        "b": rescale_samples(F.col("b"), 1021),
    }))


@query("yuv_to_rgb", point_sql(
    RGB_SQL,
    clamp_sql("(1000 * r + 1140 * (b - 128)) // 1000"),
    clamp_sql("(1000 * r - 396 * (g - 128) - 581 * (b - 128)) // 1000"),
    clamp_sql("(1000 * r + 2029 * (g - 128)) // 1000")))
def _(spark, d):
    new = yuv_to_rgb(F.col("r"), F.col("g") - 128, F.col("b") - 128)
    return shown(rgb(spark, d).withColumns(new))


@query("pack_argb", sql(ARGB_SQL, """
SELECT image_id, y, x, CAST(a AS BIGINT) * 16777216 + r * 65536 + g * 256 + b AS word FROM px"""))
def _(spark, d):
    word = pack_argb(F.col("a"), F.col("r"), F.col("g"), F.col("b"))
    return argb(spark, d).select("image_id", "y", "x", word.alias("word"))


@query("unpack_argb", """
SELECT l_orderkey, CAST((w >> 24) & 255 AS INTEGER) AS a, CAST((w >> 16) & 255 AS INTEGER) AS r,
       CAST((w >> 8) & 255 AS INTEGER) AS g, CAST(w & 255 AS INTEGER) AS b
FROM (SELECT l_orderkey, (l_orderkey * 2654435 + l_partkey * 977 + l_linenumber) % 4294967296 AS w
      FROM lineitem)""")
def _(spark, d):
    table = spark.read.parquet(f"{d}/lineitem.parquet")
    word = (F.col("l_orderkey") * 2654435 + F.col("l_partkey") * 977
            + F.col("l_linenumber")) % 4294967296
    channels = unpack_argb(word)
    return table.select("l_orderkey", *[v.alias(c) for c, v in channels.items()])


@query("add_constant", point_sql(
    ARGB_SQL, clamp_sql("r + 40"), clamp_sql("g - 70"), clamp_sql("b + 0"), clamp_sql("a + 100")))
def _(spark, d):
    return shown(tone.add_constant(argb(spark, d), 40, -70, 0, 100), "a")


@query("add_constant_gray", each_sql(GRAY_SQL, clamp_sql("{c} - 33")))
def _(spark, d):
    return shown(tone.add_constant(gray(spark, d), grey=-33))


SEPIA = [min(255, (v * v + 40 * v) // 290) for v in range(256)]


@query("lut_apply", lut_sql(RGB_SQL, SEPIA))
def _(spark, d):
    return shown(tone.lut_apply(rgb(spark, d), SEPIA))


@query("lut_apply_per_image", sql_then(GRAY_SQL, """
gain AS (SELECT image_id, max(r) AS hi FROM px GROUP BY image_id)""", """
SELECT p.image_id, p.y, p.x, CAST(least(255, r * 255 // greatest(hi, 1)) AS INTEGER) AS r,
       CAST(least(255, g * 255 // greatest(hi, 1)) AS INTEGER) AS g,
       CAST(least(255, b * 255 // greatest(hi, 1)) AS INTEGER) AS b
FROM px p JOIN gain USING (image_id)"""))
def _(spark, d):
    df = gray(spark, d)
    return shown(stats.lut_apply_per_image(df, stats.stretch_tables(df)))


@query("brightness", each_sql(RGB_SQL, "least(255, {c} * (1000 + 350) // 1000)"))
def _(spark, d):
    return shown(tone.brightness(rgb(spark, d), 0.35))


@query("brightness_expression", each_sql(GRAY_SQL, "least(255, {c} * 600 // 1000)"))
def _(spark, d):
    return shown(tone.brightness(gray(spark, d), -0.4))


@query("contrast", each_sql(RGB_SQL, "trunc(least(255e0, greatest(0e0, 256e0 * {c} / 153.6e0 + (128e0 - 32768e0 / 153.6e0))))"))
def _(spark, d):
    return shown(tone.contrast(rgb(spark, d), 0.4))


@query("contrast_reduce", each_sql(
    GRAY_SQL, "CAST(floor(greatest(0.0, least(255.0, (256.0 - 2.0 * 38.4) * {c} / 256.0 + 38.4))) AS INTEGER)"))
def _(spark, d):
    return shown(tone.contrast(gray(spark, d), -0.3))


@query("gamma", each_sql(RGB_SQL, "floor(pow({c} / 255e0, 1e0 / 1.8e0) * 255e0 + 0.5e0)"))
def _(spark, d):
    return shown(tone.gamma(rgb(spark, d), 1.8))


@query("negative", each_sql(RGB_SQL, "255 - {c}"))
def _(spark, d):
    return shown(tone.negative(rgb(spark, d)))


@query("negative_bytes", sql(PLOT_SQL, """
SELECT image_id, y, CAST(sum(255 - r) AS BIGINT) AS line_sum, CAST(max(255 - r) AS INTEGER) AS line_max
FROM px GROUP BY image_id, y"""))
def _(spark, d):
    df = tone.negative(plot(spark, d))
    return df.groupBy("image_id", "y").agg(
        F.sum("r").alias("line_sum"), F.max("r").alias("line_max"))


@query("threshold_channel", point_sql(
    ARGB_SQL, *["CASE WHEN %s < 128 THEN 0 ELSE 255 END" % c for c in "rgba"]))
def _(spark, d):
    return shown(tone.threshold_channel(argb(spark, d), 128), "a")


@query("threshold_intensity", each_sql(
    RGB_SQL, "CASE WHEN (r + g + b) // 3 < 120 THEN 0 ELSE 255 END"))
def _(spark, d):
    return shown(color.threshold_intensity(rgb(spark, d), 120))


@query("grayscale", each_sql(RGB_SQL, "(30 * r + 59 * g + 11 * b) // 100"))
def _(spark, d):
    return shown(color.grayscale(rgb(spark, d)))


@query("grayscale_region", each_sql(
    ARGB_SQL, "(30 * r + 59 * g + 11 * b) // 100", a="a", where=BOX_SQL))
def _(spark, d):
    return shown(color.grayscale(argb(spark, d), box()), "a")


@query("truecolor", sql(ARGB_SQL, "SELECT image_id, y, x, CAST(NULL AS INTEGER) AS a, r, g, b FROM px"))
def _(spark, d):
    return shown(color.truecolor(argb(spark, d)), "a")


@query("bitfield", point_sql(
    ARGB_SQL, *["((%s & 60) << 2) & 255" % c for c in "rgba"]))
def _(spark, d):
    return shown(tone.bitfield(argb(spark, d), 2, 5), "a")


@query("extract_channels", point_sql(ARGB_SQL, "r", "0", "b", "0"))
def _(spark, d):
    return shown(color.extract_channels(argb(spark, d), "rb"), "a")


@query("color_mix", point_sql(
    ARGB_SQL,
    clamp_sql("r * 500 // 1000 + g * -250 // 1000 + b * 1200 // 1000"),
    clamp_sql("g * 1000 // 1000 + a * -1000 // 1000"),
    clamp_sql("r * 333 // 1000 + g * 333 // 1000 + b * 333 // 1000"),
    clamp_sql("b * 250 // 1000 + a * 500 // 1000")))
def _(spark, d):
    return shown(color.color_mix(
        argb(spark, d), red="0.5,-0.25,1.2", green="0,1,0,-1",
        blue="0.333,0.333,0.333", alpha="0,0,0.25,0.5"), "a")


@query("color_change", point_sql(RGB_SQL, *[
    "CASE WHEN (r - 120) * (r - 120) + (g - 100) * (g - 100) + (b - 90) * (b - 90) <= 4900 "
    f"THEN {clamp_sql(f'{c} + ({k})')} ELSE {c} END"
    for c, k in (("r", 130), ("g", -80), ("b", 10))]))
def _(spark, d):
    return shown(color.color_change(rgb(spark, d), (120, 100, 90), (250, 20, 100), 70))


@query("transparency", sql(RGB_SQL, f"""
SELECT image_id, y, x, CASE WHEN {BOX_SQL} AND (r - 128) * (r - 128) + (g - 128) * (g - 128)
       + (b - 128) * (b - 128) <= 6400 THEN 200 ELSE 0 END AS a, r, g, b FROM px"""))
def _(spark, d):
    return shown(color.transparency(
        rgb(spark, d), 200, (128, 128, 128), 80, region=box()), "a")


@query("transparency_all", sql(ARGB_SQL, f"""
SELECT image_id, y, x, CASE WHEN {BOX_SQL} THEN 77 ELSE a END AS a, r, g, b FROM px"""))
def _(spark, d):
    return shown(color.transparency(argb(spark, d), 77, everything=True, region=box()), "a")


CORNERS_SQL = """
bg AS (SELECT image_id, CAST(sum(r) // 4 AS INTEGER) AS br, CAST(sum(g) // 4 AS INTEGER) AS bgr,
              CAST(sum(b) // 4 AS INTEGER) AS bb
       FROM px WHERE x IN (0, width - 1) AND y IN (0, height - 1) GROUP BY image_id)"""


@query("transparency_background", sql_then(RGB_SQL, CORNERS_SQL, """
SELECT p.image_id, y, x, CASE WHEN (r - br) * (r - br) + (g - bgr) * (g - bgr) + (b - bb) * (b - bb)
       <= 8100 THEN 255 ELSE 0 END AS a, r, g, b FROM px p JOIN bg USING (image_id)"""))
def _(spark, d):
    df = rgb(spark, d)
    return shown(color.transparency(df, 255, tolerance=90, background=True, rows=rgb_images(spark, d)), "a")


@query("flatten_alpha", each_sql(ARGB_SQL, "({c} * (255 - a)) >> 8"))
def _(spark, d):
    return shown(color.flatten_alpha(argb(spark, d)))


def hash_sql(channel: int, seed: int) -> str:
    base = (f"({channel * noise.CHANNEL_STEP + seed * noise.SEED_STEP} + image_id % {noise.MODULUS} * 7919"
            f" + CAST(y AS BIGINT) * 104729 + CAST(x AS BIGINT) * 1299709) % {noise.MODULUS}")
    return f"({base})"


def noise_sql(kind: str, frequency: int, seed: int) -> str:
    m = noise.MODULUS
    cols = ", ".join(f"{hash_sql(i, seed)} AS f{c}" for i, c in enumerate("rgb"))
    mixed = ", ".join(
        f"(f{c} * ((f{c} * 48271 + 11) % {m}) + (f{c} * 48271 + 11) % {m}) % {m} AS h{c}" for c in "rgb")

    def out(c: str) -> str:
        sign = f"(CASE WHEN (h{c} // 100) % 2 = 1 THEN 1 ELSE -1 END)"
        unit = f"((h{c} // 100) // 2) % 1000"
        if kind == "add":
            new = clamp_sql(f"{c} + {sign} * ({unit} * {255 * 60} // 100000)")
        elif kind == "mul":
            new = clamp_sql(f"{c} + {sign} * ({c} * ({unit}) * 60 // 100000)")
        else:
            new = f"CASE WHEN {sign} > 0 THEN 255 ELSE 0 END"
        return f"CASE WHEN h{c} % 100 < {frequency} THEN {new} ELSE {c} END AS {c}"

    return sql_then(RGB_SQL, f"first AS (SELECT *, {cols} FROM px), second AS (SELECT *, {mixed} FROM first)",
                    f"SELECT image_id, y, x, {', '.join(out(c) for c in 'rgb')} FROM second")


@query("noise_additive", noise_sql("add", 40, 3))
def _(spark, d):
    return shown(noise.noise_additive(rgb(spark, d), 40, 60, seed=3))


@query("noise_multiplicative", noise_sql("mul", 55, 4))
def _(spark, d):
    return shown(noise.noise_multiplicative(rgb(spark, d), 55, 60, seed=4))


@query("noise_salt_pepper", noise_sql("salt", 10, 5))
def _(spark, d):
    return shown(noise.noise_salt_pepper(rgb(spark, d), 10, seed=5))


# The 4 x 4 matrix as published, row by row.
BAYER4_SQL = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"


@query("ordered_dither", each_sql(
    RGB_SQL, f"((({{c}} + ({BAYER4_SQL})[(y & 3) * 4 + (x & 3) + 1]) << 4) - {{c}}) >> 4"))
def _(spark, d):
    return shown(ordered.ordered_dither(rgb(spark, d)))


@query("pixel_udf", point_sql(
    RGB_SQL, clamp_sql("r + x * 2 - y"), clamp_sql("(g + b) // 2"), clamp_sql("b - g + 64"), where=BOX_SQL))
def _(spark, d):
    def tint(r, g, b, row, col):
        return r + col * 2 - row, F.floor((g + b) / 2), b - g + 64

    return shown(color.pixel_udf(rgb(spark, d), tint, box()))


@query("pixel_udf_arrays", point_sql(
    RGB_SQL, clamp_sql("r + x * 2 - y"), clamp_sql("(g + b) // 2"), clamp_sql("b - g + 64")))
def _(spark, d):
    def tint(r, g, b, row, col):
        return r + col * 2 - row, (g + b) // 2, b - g + 64

    return shown(color.pixel_udf_arrays(rgb(spark, d), tint))


# A ring with a dot, given as (dy, dx) cells.
RING = [(dy, dx) for dy in range(-5, 6) for dx in range(-5, 6)
        if 16 <= dy * dy + dx * dx <= 25 or dy == dx == 0]


@query("stamp_mask", sql_then(ARGB_SQL, "mask(dy, dx) AS (VALUES "
       + ", ".join(map(str, RING)) + ")", """
SELECT image_id, y, x, a, CASE WHEN m.dy IS NULL THEN r ELSE 255 END AS r,
       CASE WHEN m.dy IS NULL THEN g ELSE 200 END AS g, CASE WHEN m.dy IS NULL THEN b ELSE 0 END AS b
FROM px LEFT JOIN mask m ON y = 3 + m.dy AND x = 12 + m.dx"""))
def _(spark, d):
    mask = spark.createDataFrame(RING, "dy int, dx int")
    return shown(combine.stamp_mask(
        argb(spark, d), mask, top=3, left=12, color=(255, 200, 0), rows=len(RING)), "a")
