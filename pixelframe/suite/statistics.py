"""Histograms, counts, equalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tone
from ..operators import regions, stats
from .core import (
    ARGB_SQL, GRAY_SQL, PLOT_SQL, RGB_SQL, argb, gray, gray_images, plot, query, rgb,
    shown, sql, sql_then,
)
from .points import BOX_SQL, CORNERS_SQL, box

BIN_SQL = "(r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3)"


def histogram_sql(source: str, ctes: str = "", relation: str = "px", where: str = "") -> str:
    cond = f" WHERE {where}" if where else ""
    parts = " UNION ALL ".join(
        f"SELECT image_id, '{c}' AS channel, {c} AS value FROM {relation}{cond}" for c in "rgb")
    body = f"SELECT image_id, channel, value, count(*) AS n FROM ({parts}) GROUP BY ALL"
    return sql_then(source, ctes, body) if ctes else sql(source, body)


@query("channel_histogram", histogram_sql(RGB_SQL))
def _(spark, d):
    return stats.channel_histogram(rgb(spark, d))


@query("region_histogram", histogram_sql(GRAY_SQL, """
lit AS (SELECT image_id, y, x, least(255, r * (1000 + 200) // 1000) AS r, least(255, g * (1000 + 200) // 1000) AS g,
               least(255, b * (1000 + 200) // 1000) AS b FROM px)""", "lit", "x >= 8 AND x < 56 AND y >= 10 AND y < 60"))
def _(spark, d):
    """The flagship: source, filter, projection, aggregation."""
    area = regions.rect(8, 10, 56, 60)
    return stats.channel_histogram(tone.brightness(gray(spark, d), 0.2, area), area)


@query("byte_histogram", sql(PLOT_SQL, """
SELECT image_id, r AS value, count(*) AS n FROM px GROUP BY image_id, r"""))
def _(spark, d):
    return stats.gray_histogram(plot(spark, d))


@query("color_count", sql(RGB_SQL, f"""
SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS colors FROM px WHERE {BOX_SQL} GROUP BY image_id"""))
def _(spark, d):
    return stats.color_count(rgb(spark, d), box())


@query("color_count_bytes", sql(PLOT_SQL, """
SELECT image_id, count(DISTINCT r) AS colors FROM px GROUP BY image_id"""))
def _(spark, d):
    return stats.color_count(plot(spark, d))


@query("color_count_estimate", sql(RGB_SQL, """
SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) AS exact, true AS within FROM px GROUP BY image_id"""))
def _(spark, d):
    """The estimate beside the exact count: within three standard errors (and one colour)."""
    df = rgb(spark, d)
    both = stats.color_count_estimate(df, 0.02).join(
        stats.color_count(df).withColumnRenamed("colors", "exact"), "image_id")
    near = F.abs(F.col("colors") - F.col("exact")) <= 0.06 * F.col("exact") + 1
    return both.select("image_id", "exact", near.alias("within"))


@query("color_histogram_565", sql(RGB_SQL, f"""
SELECT image_id, {BIN_SQL} AS bin, count(*) AS n FROM px GROUP BY image_id, bin"""))
def _(spark, d):
    return stats.color_histogram_565(rgb(spark, d))


@query("delta_weighted_histogram", sql_then(RGB_SQL, f"""
stepped AS (
  SELECT image_id, {BIN_SQL} AS bin,
         coalesce(lag(r) OVER w, 0) - r AS dr, coalesce(lag(g) OVER w, 0) - g AS dg,
         coalesce(lag(b) OVER w, 0) - b AS db
  FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x))""", """
SELECT image_id, bin, CAST(sum(floor(sqrt(CASE
         WHEN dr < dg AND dr < db THEN dg * dg + db * db
         WHEN dg < db THEN dr * dr + db * db ELSE dr * dr + dg * dg END))) AS BIGINT) AS weight
FROM stepped GROUP BY image_id, bin"""))
def _(spark, d):
    return stats.delta_weighted_histogram(rgb(spark, d))


@query("delta_weighted_histogram_gray", sql_then(GRAY_SQL, f"""
stepped AS (
  SELECT image_id, {BIN_SQL} AS bin, abs(coalesce(lag(r) OVER (PARTITION BY image_id, y ORDER BY x), 0) - r) AS w
  FROM px)""", "SELECT image_id, bin, CAST(sum(w) AS BIGINT) AS weight FROM stepped GROUP BY image_id, bin"))
def _(spark, d):
    return stats.delta_weighted_histogram(gray(spark, d), gray=True)


def equalise_sql(source: str, where: str = "") -> str:
    cond = f"WHERE {where}" if where else ""
    ctes, joins, cols = [], [], []
    for c in "rgb":
        ctes.append(f"""
lut_{c} AS (
  SELECT image_id, {c} AS v,
         CAST(255 * sum(count(*)) OVER (PARTITION BY image_id ORDER BY {c} ROWS UNBOUNDED PRECEDING)
              // sum(count(*)) OVER (PARTITION BY image_id) AS INTEGER) AS m
  FROM px {cond} GROUP BY image_id, {c})""")
        joins.append(f"LEFT JOIN lut_{c} ON lut_{c}.image_id = p.image_id AND lut_{c}.v = p.{c}")
        new = f"lut_{c}.m"
        cols.append(f"CASE WHEN {where} THEN {new} ELSE p.{c} END AS {c}" if where else f"{new} AS {c}")
    return sql_then(source, ",".join(ctes), f"SELECT p.image_id, y, x, {', '.join(cols)} FROM px p {' '.join(joins)}")


@query("hist_eq_global", equalise_sql(GRAY_SQL))
def _(spark, d):
    return shown(stats.hist_eq_global(gray(spark, d), rows=gray_images(spark, d)))


@query("hist_eq_global_region", equalise_sql(RGB_SQL, BOX_SQL))
def _(spark, d):
    return shown(stats.hist_eq_global(rgb(spark, d), box()))


@query("background_color", sql_then(RGB_SQL, CORNERS_SQL, """
SELECT image_id, br AS r, bgr AS g, bb AS b FROM bg"""))
def _(spark, d):
    return stats.background_color(rgb(spark, d))


@query("grey_intensity_preview", sql(RGB_SQL, """
SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, CAST((r + g + b) // 3 AS INTEGER) AS v
FROM px WHERE y % 2 = 0 AND x % 4 = 0"""))
def _(spark, d):
    return stats.grey_intensity_preview(rgb(spark, d), 8, 16)


@query("image_stats", sql(ARGB_SQL, """
SELECT image_id, max(width) AS width, max(height) AS height, count(*) * 4 AS capacity,
       CAST(image_id % 300 * 800 // (count(*) * 4) AS BIGINT) AS used_percent
FROM px GROUP BY image_id"""))
def _(spark, d):
    return stats.image_stats(argb(spark, d), F.col("image_id") % 300)


@query("frame_info", sql(ARGB_SQL, """
SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height,
       CASE WHEN count(a) > 0 THEN 'ARGB' WHEN bool_and(r = g AND g = b) THEN 'GRAY' ELSE 'RGB' END AS colorspace,
       count(*) AS pixels, count(*) * 4 // (max(y) + 1) AS bytes_per_row
FROM px GROUP BY image_id"""))
def _(spark, d):
    from ..operators import catalog
    return catalog.frame_info(argb(spark, d))


