"""Sources, constant rasters and format sniffing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import density
from ..session import fresh_path
from ..sources import files, generate, images, tables
from .core import (
    ARGB_SQL, GRAY_SQL, PLOT_SQL, RGB_SQL, argb, gray, plot, query, rgb, shown, sql,
)


@query("raster_from_table", sql(GRAY_SQL, "SELECT image_id, y, x, r, g, b FROM px"))
def _(spark, d):
    return shown(gray(spark, d))


@query("raster_from_orders", sql(ARGB_SQL, "SELECT image_id, y, x, a, r, g, b FROM px"))
def _(spark, d):
    return shown(argb(spark, d), "a")


LINES_SQL = """
ranked AS (
  SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY
           (first * ((first * 48271 + 11) % 2147483647) + (first * 48271 + 11) % 2147483647) % 2147483647, l_orderkey,
           l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS k,
         (l_linenumber * 36) % 256 AS a, CAST(floor(l_quantity * 5) AS BIGINT) % 256 AS r,
         CAST(floor(l_extendedprice) AS BIGINT) % 256 AS g, l_partkey % 256 AS b
  FROM (SELECT *, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 1299709) % 2147483647 AS first FROM lineitem)),
ends AS (SELECT s, count(*) AS n FROM ranked GROUP BY s),
full_pages AS (
  SELECT * FROM ranked
  UNION ALL
  SELECT s, unnest(range(n, (n + 1023) // 1024 * 1024)), 0, 0, 0, 0 FROM ends),
px AS (
  SELECT s * 4294967296 + k // 1024 AS image_id, 32 AS width, 32 AS height,
         CAST((k % 1024) // 32 AS INTEGER) AS y, CAST(k % 32 AS INTEGER) AS x,
         CAST(a AS INTEGER) AS a, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g,
         CAST(b AS INTEGER) AS b
  FROM full_pages)"""


@query("raster_from_lineitem", sql(LINES_SQL, "SELECT image_id, y, x, a, r, g, b FROM px"))
def _(spark, d):
    return shown(tables.rgb_from_lineitem(spark, d), "a")


@query("raster_from_documents", sql(PLOT_SQL, """
SELECT image_id, y, CAST(sum(r * (x + 1)) AS BIGINT) AS checksum, CAST(max(height) AS INTEGER) AS height
FROM px GROUP BY image_id, y"""))
def _(spark, d):
    return plot(spark, d).groupBy("image_id", "y").agg(
        F.sum(F.col("r") * (F.col("x") + 1)).alias("checksum"), F.max("height").alias("height"))


@query("raster_density", sql(ARGB_SQL, """
SELECT image_id, max(width) AS width, max(height) AS height, count(*) AS n,
       count(*) = max(width) * max(height) AND max(x) + 1 = max(width)
       AND max(y) + 1 = max(height) AND min(x) = 0 AND min(y) = 0 AS dense
FROM px GROUP BY image_id"""))
def _(spark, d):
    return density(argb(spark, d)).select("image_id", "width", "height", "n", "dense")


@query("constant_raster", """
SELECT p_partkey AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 30 AS r, 144 AS g, 255 AS b
FROM (SELECT p_partkey, x, unnest(range(0, 1 + p_size % 7)) AS y
      FROM (SELECT p_partkey, p_size, unnest(range(0, 1 + p_partkey % 5)) AS x FROM part))""")
def _(spark, d):
    part = tables.read_table(spark, d, "part")
    sizes = part.select(
        F.col("p_partkey").alias("image_id"),
        (F.col("p_partkey") % 5 + 1).alias("width"),
        (F.col("p_size") % 7 + 1).alias("height"))
    return shown(generate.constant_raster(sizes, (30, 144, 255)))


# One sample header per format, in the order they are tried.
HEADERS = [
    ("424D", "bmp"), ("474946383961", "gif"), ("FFD8FFE0", "jpeg"), ("89504E470D0A1A0A", "png"),
    ("50360A", "ppm"), ("504943DC", "pic"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
    ("474946383800", "?"), ("0000", "?"),
]
SUFFIXES = ["", ".BMP", ".gif89", ".jfif", ".png", ".pgm", ".pic", ".tif", ".tga", ".lbm", ".txt"]


@query("sniff_format", f"""
WITH blobs AS (
  SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) || ({SUFFIXES})[doc_id % 11 + 1] AS name,
         ({[h for h, _ in HEADERS]})[doc_id % 10 + 1] || hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE
  WHEN lower(name) LIKE '%.bmp' THEN 'bmp' WHEN lower(name) LIKE '%.gif89' THEN 'gif'
  WHEN lower(name) LIKE '%.jfif' THEN 'jpeg' WHEN lower(name) LIKE '%.png' THEN 'png'
  WHEN lower(name) LIKE '%.pgm' THEN 'ppm' WHEN lower(name) LIKE '%.pic' THEN 'pic'
  WHEN lower(name) LIKE '%.tif' THEN 'tiff' WHEN lower(name) LIKE '%.tga' THEN 'targa'
  WHEN lower(name) LIKE '%.lbm' THEN 'ilbm'
  WHEN h LIKE '424D%' THEN 'bmp' WHEN h LIKE '474946383961%' OR h LIKE '474946383761%' THEN 'gif'
  WHEN h LIKE 'FFD8%' THEN 'jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png'
  WHEN h LIKE '5036%' OR h LIKE '5035%' OR h LIKE '5033%' OR h LIKE '5032%' THEN 'ppm'
  WHEN h LIKE '504943DC%' THEN 'pic' WHEN h LIKE '4949%' OR h LIKE '4D4D%' THEN 'tiff'
  END AS format
FROM blobs""")
def _(spark, d):
    docs = tables.read_table(spark, d, "documents")
    header = F.unhex(F.lit([h for h, _ in HEADERS])[F.col("doc_id") % 10])
    blobs = docs.select(
        "doc_id",
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(SUFFIXES)[F.col("doc_id") % 11]).alias("path"),
        F.concat(header, F.encode("text", "UTF-8")).alias("content"))
    return blobs.select("doc_id", files.sniff_format(F.col("path"), F.col("content")).alias("format"))


@query("load_images", sql(RGB_SQL, "SELECT image_id, width, height, y, x, a, r, g, b FROM px"))
def _(spark, d):
    """Files made from the orders raster by the image sink, read by the image source."""
    path = fresh_path(spark)
    images.save_images(rgb(spark, d), path)
    number = lambda origin: F.regexp_extract(origin, r"(\d+)\.png$", 1)
    return files.load_images(spark, path, number)


@query("save_images", sql(ARGB_SQL, "SELECT image_id, y, x, a, r, g, b FROM px"))
def _(spark, d):
    """The same with alpha."""
    path = fresh_path(spark)
    images.save_images(argb(spark, d), path, alpha=True)
    number = lambda origin: F.regexp_extract(origin, r"(\d+)\.png$", 1)
    return shown(files.load_images(spark, path, number), "a")
