"""Palettes, nearest pens, dithering."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..layout import heads
from ..operators import quantize
from ..sources.tables import read_table
from .core import (
    ARGB_SQL, GRAY_SQL, RGB_SQL, argb, dither_sql, gray, gray_images, median_cut_gray_sql, median_cut_sql, query, rgb, rgb_images, sql, sql_then,
)
from .points import BAYER4_SQL

POPULAR_SQL = """
bins AS (SELECT image_id, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS bin, count(*) AS n
         FROM px GROUP BY image_id, bin),
palette AS (
  SELECT image_id, pen, CAST((bin // 2048) * 8 + (bin // 2048) // 4 AS INTEGER) AS r,
         CAST((bin // 32) % 64 * 4 + (bin // 32) % 64 // 16 AS INTEGER) AS g,
         CAST(bin % 32 * 8 + bin % 32 // 4 AS INTEGER) AS b
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) - 1 AS INTEGER) AS pen
        FROM bins) WHERE pen < {n})"""
POPULAR_GRAY_SQL = """
levels AS (SELECT image_id, r AS value, count(*) AS n FROM px GROUP BY image_id, r),
palette AS (
  SELECT image_id, pen, value AS r, value AS g, value AS b
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, value) - 1 AS INTEGER) AS pen
        FROM levels) WHERE pen < {n})"""
FORCED_SQL = """
stored AS (
  SELECT n_regionkey AS palette_id,
         CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pen,
         (n_nationkey * 53) % 256 AS r, (n_nationkey * 101 + 40) % 256 AS g, (n_nationkey * 17 + 90) % 256 AS b
  FROM nation),
palette AS (
  SELECT i.image_id, s.pen, s.r, s.g, s.b
  FROM (SELECT DISTINCT image_id FROM px) i JOIN stored s ON s.palette_id = i.image_id % 5)"""


def nearest_sql(source: str) -> str:
    return f"""
SELECT p.image_id, p.y, p.x,
       CAST(arg_min(q.pen, ((p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g)
                            + (p.b - q.b) * (p.b - q.b)) * 1024 + q.pen) AS INTEGER) AS pen
FROM {source} p JOIN palette q ON q.image_id = p.image_id GROUP BY p.image_id, p.y, p.x"""


def pens(df):
    return df.select("image_id", "y", "x", "pen")


def forced(spark, d, df):
    nation = read_table(spark, d, "nation")
    rank = F.row_number().over(
        Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    key = F.col("n_nationkey")
    stored = nation.select(
        F.col("n_regionkey").alias("palette_id"), (rank - 1).alias("pen"), ((key * 53) % 256).alias("r"),
        ((key * 101 + 40) % 256).alias("g"), ((key * 17 + 90) % 256).alias("b"))
    images = heads(df).select("image_id", (F.col("image_id") % 5).cast("int").alias("palette_id"))
    return quantize.palette_force(images, stored)


@query("palette_popularity", sql_then(RGB_SQL, POPULAR_SQL.format(n=24),
                                      "SELECT image_id, pen, r, g, b FROM palette"))
def _(spark, d):
    return quantize.palette_popularity(rgb(spark, d), 24)


@query("palette_popularity_gray", sql_then(GRAY_SQL, POPULAR_GRAY_SQL.format(n=12),
                                           "SELECT image_id, pen, r, g, b FROM palette"))
def _(spark, d):
    return quantize.palette_popularity_gray(gray(spark, d), 12)


@query("palette_median_cut", median_cut_sql(RGB_SQL, 32))
def _(spark, d):
    return quantize.palette_median_cut(rgb(spark, d), 32)


@query("palette_median_cut_gray", median_cut_gray_sql(GRAY_SQL, 16))
def _(spark, d):
    return quantize.palette_median_cut_gray(gray(spark, d), 16)


@query("palette_force", sql_then(RGB_SQL, FORCED_SQL, "SELECT image_id, pen, r, g, b FROM palette"))
def _(spark, d):
    return forced(spark, d, rgb(spark, d))


@query("palette_halfbright", sql_then(RGB_SQL, POPULAR_SQL.format(n=16), """
SELECT image_id, pen, r, g, b FROM palette
UNION ALL
SELECT image_id, CAST(pen + max(pen) OVER (PARTITION BY image_id) + 1 AS INTEGER), r // 2, g // 2, b // 2
FROM palette"""))
def _(spark, d):
    return quantize.palette_halfbright(quantize.palette_popularity(rgb(spark, d), 16))


@query("map_to_palette", sql_then(RGB_SQL, POPULAR_SQL.format(n=16), nearest_sql("px")))
def _(spark, d):
    df = rgb(spark, d)
    palette = quantize.palette_popularity(df, 16)
    return pens(quantize.map_to_palette(df, palette, 16, rgb_images(spark, d)))


@query("map_to_palette_large", sql_then(RGB_SQL, POPULAR_SQL.format(n=200), nearest_sql("px")))
def _(spark, d):
    df = rgb(spark, d)
    return pens(quantize.map_to_palette(df, quantize.palette_popularity(df, 200), 200))


@query("map_gray_to_palette", sql_then(GRAY_SQL, POPULAR_GRAY_SQL.format(n=12), nearest_sql("px")))
def _(spark, d):
    df = gray(spark, d)
    palette = quantize.palette_popularity_gray(df, 12)
    return pens(quantize.map_gray_to_palette(df, palette, gray_images(spark, d)))


@query("dither_floyd_steinberg", dither_sql(RGB_SQL, POPULAR_SQL.format(n=16), "rgb"))
def _(spark, d):
    df = rgb(spark, d)
    palette = quantize.palette_popularity(df, 16)
    return pens(quantize.dither_floyd_steinberg(df, palette, rgb_images(spark, d)))


@query("dither_floyd_steinberg_gray", dither_sql(GRAY_SQL, POPULAR_GRAY_SQL.format(n=8), "r"))
def _(spark, d):
    df = gray(spark, d)
    palette = quantize.palette_popularity_gray(df, 8)
    return pens(quantize.dither_floyd_steinberg_gray(df, palette, gray_images(spark, d)))


@query("render_indexed", sql_then(RGB_SQL, POPULAR_SQL.format(n=16) + f""",
lifted AS (
  SELECT image_id, y, x, ((r + m) * 16 - r) >> 4 AS r, ((g + m) * 16 - g) >> 4 AS g, ((b + m) * 16 - b) >> 4 AS b
  FROM (SELECT *, ({BAYER4_SQL})[(y % 4) * 4 + x % 4 + 1] AS m FROM px))""", nearest_sql("lifted")))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        rgb(spark, d), 16, "ordered", "popularity", rgb_images(spark, d))
    return indexed


@query("render_indexed_forced", sql_then(RGB_SQL, FORCED_SQL, nearest_sql("px")))
def _(spark, d):
    df = rgb(spark, d)
    indexed, _ = quantize.render_indexed(df, 5, "none", forced(spark, d, df), rgb_images(spark, d))
    return indexed


@query("render_indexed_floyd", dither_sql(RGB_SQL, f"palette AS ({median_cut_sql(RGB_SQL, 16)})", "rgb"))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        rgb(spark, d), 16, "floyd", "median_cut", rgb_images(spark, d))
    return indexed


LIFTED_GRAY_SQL = f"""
lifted AS (
  SELECT image_id, y, x, ((r + m) * 16 - r) >> 4 AS r, ((r + m) * 16 - r) >> 4 AS g, ((r + m) * 16 - r) >> 4 AS b
  FROM (SELECT *, ({BAYER4_SQL})[(y % 4) * 4 + x % 4 + 1] AS m FROM px))"""


@query("render_indexed_gray", sql_then(GRAY_SQL, POPULAR_GRAY_SQL.format(n=12) + "," + LIFTED_GRAY_SQL, nearest_sql("lifted")))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        gray(spark, d), 12, "ordered", "popularity", gray_images(spark, d), gray=True)
    return indexed


@query("render_indexed_alpha", sql_then(ARGB_SQL, POPULAR_SQL.format(n=16) + """,
lifted AS (SELECT image_id, y, x, (r * (255 - a)) >> 8 AS r, (g * (255 - a)) >> 8 AS g, (b * (255 - a)) >> 8 AS b FROM px)""",
    nearest_sql("lifted")))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        argb(spark, d), 16, "none", "popularity", rgb_images(spark, d), alpha=True)
    return indexed


@query("render_halfbright", sql_then(RGB_SQL, POPULAR_SQL.format(n=16).replace("palette AS", "full_pens AS") + """,
palette AS (
  SELECT * FROM full_pens
  UNION ALL
  SELECT image_id, CAST(pen + max(pen) OVER (PARTITION BY image_id) + 1 AS INTEGER), r // 2, g // 2, b // 2
  FROM full_pens)""", nearest_sql("px")))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        rgb(spark, d), 16, "none", "popularity", rgb_images(spark, d), halfbright=True)
    return indexed


def near_pen_sql(source: str, shade: int) -> str:
    gap = " + ".join(f"({c} - {shade}) * ({c} - {shade})" for c in "rgb")
    return f"SELECT image_id, arg_min(pen, ({gap}) * 1024 + pen) AS best FROM {source} GROUP BY image_id"


BLACK_WHITE_SQL = POPULAR_SQL.format(n=16).replace("palette AS", "found AS") + f""",
light AS ({near_pen_sql('found', 255)}),
lit AS (
  SELECT f.image_id, CASE WHEN pen = 1 THEN best WHEN pen = best THEN 1 ELSE pen END AS pen, r, g, b
  FROM found f JOIN light USING (image_id)),
white AS (SELECT image_id, pen, CASE WHEN pen = 1 THEN 255 ELSE r END AS r, CASE WHEN pen = 1 THEN 255 ELSE g END AS g,
                 CASE WHEN pen = 1 THEN 255 ELSE b END AS b FROM lit),
dark AS ({near_pen_sql('white', 0)}),
palette AS (
  SELECT image_id, pen, CASE WHEN pen = 0 THEN 0 ELSE r END AS r, CASE WHEN pen = 0 THEN 0 ELSE g END AS g,
         CASE WHEN pen = 0 THEN 0 ELSE b END AS b
  FROM (SELECT w.image_id, CASE WHEN pen = 0 THEN best WHEN pen = best THEN 0 ELSE pen END AS pen, r, g, b
        FROM white w JOIN dark USING (image_id)))"""


@query("render_force_bw", sql_then(RGB_SQL, BLACK_WHITE_SQL, nearest_sql("px")))
def _(spark, d):
    indexed, _ = quantize.render_indexed(
        rgb(spark, d), 16, "none", "popularity", rgb_images(spark, d), force_bw=True)
    return indexed
