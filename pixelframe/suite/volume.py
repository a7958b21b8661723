"""The byte plot of all documents through one operator of each kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kernels import preset
from ..operators import geometry, stats, stencil
from .core import PLOT_SQL, plot, plot_images, query, sql_then


def per_line(df):
    """Checksums per scan line: the pixels themselves would be too many rows to compare."""
    return df.groupBy("image_id", "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("r").cast("bigint") * (F.col("x") + 1)).alias("checksum"))


LINES_SQL = """
SELECT image_id, y, count(*) AS n, CAST(sum(CAST(v AS BIGINT) * (x + 1)) AS BIGINT) AS checksum
FROM result GROUP BY image_id, y"""


@query("equalise_bytes", sql_then(PLOT_SQL, """
lut AS (
  SELECT image_id, r AS v0, 255 * sum(count(*)) OVER (PARTITION BY image_id ORDER BY r ROWS UNBOUNDED PRECEDING)
         // sum(count(*)) OVER (PARTITION BY image_id) AS v
  FROM px GROUP BY image_id, r),
result AS (SELECT p.image_id, y, x, v FROM px p JOIN lut l ON l.image_id = p.image_id AND v0 = r)""", LINES_SQL))
def _(spark, d):
    return per_line(stats.hist_eq_global(plot(spark, d), rows=plot_images(spark, d)))


GAUSS_SQL = """
result AS (
  SELECT image_id, y, x, (2 * r + coalesce(lag(r) OVER h, 0) + coalesce(lead(r) OVER h, 0)
                          + coalesce(lag(r) OVER v, 0) + coalesce(lead(r) OVER v, 0)) // 6 AS v
  FROM px WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y))"""
AVERAGE_SQL = """
flat AS (SELECT image_id, y, x, r + coalesce(lag(r) OVER h, 0) + coalesce(lead(r) OVER h, 0) AS s
         FROM px WINDOW h AS (PARTITION BY image_id, y ORDER BY x)),
result AS (SELECT image_id, y, x, (s + coalesce(lag(s) OVER v, 0) + coalesce(lead(s) OVER v, 0)) // 9 AS v
           FROM flat WINDOW v AS (PARTITION BY image_id, x ORDER BY y))"""


@query("convolve_bytes", sql_then(PLOT_SQL, GAUSS_SQL, LINES_SQL))
def _(spark, d):
    return per_line(stencil.convolve(plot(spark, d), preset("gauss4")))


@query("blur_bytes", sql_then(PLOT_SQL, AVERAGE_SQL, LINES_SQL))
def _(spark, d):
    return per_line(stencil.box_blur_separable(plot(spark, d), 1))


@query("scale_bytes", sql_then(PLOT_SQL, """
result AS (
  SELECT p.image_id, CAST(j AS INTEGER) AS y, CAST(i AS INTEGER) AS x, r AS v
  FROM (SELECT unnest(range(0, 24)) AS j) CROSS JOIN (SELECT unnest(range(0, 40)) AS i)
  JOIN px p ON p.x = i * 64 // 40 AND p.y = j * p.height // 24)""", LINES_SQL))
def _(spark, d):
    return per_line(geometry.thumbnail(plot(spark, d), 40, 24))
