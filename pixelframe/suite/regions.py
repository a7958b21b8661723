"""Regions, point lookup, sinks, named operators and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tone
from ..layout import as_pixels
from ..operators import catalog, quantize, regions
from ..plans.registry import frame_recipe, process, recipe
from ..session import fresh_path
from ..sources import files
from ..sources.tables import read_table
from .core import (
    ARGB_SQL, GRAY_SQL, RGB_SQL, argb, each_sql, gray, query, rgb, shown, sql, sql_then,
)
from .geometry import GRID_SQL
from .palettes import POPULAR_SQL, nearest_sql
from .points import BOX_SQL, box

FIELDS = "image_id, y, x, r, g, b"
# Half-open circle of radius 12 and a concave polygon.
CIRCLE_SQL = "(x - 15) * (x - 15) + (y - 14) * (y - 14) <= 11 * 11"
POLYGON = [(3, 2), (29, 6), (16, 15), (27, 30), (5, 25), (11, 13)]


def crossing_sql(vertices) -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 != y2:
            terms.append(
                f"(CASE WHEN y >= {min(y1, y2)} AND y < {max(y1, y2)} AND {x1} + CAST(y - {y1} AS DOUBLE)"
                f" * {x2 - x1} / CAST({y2 - y1} AS DOUBLE) > x THEN 1 ELSE 0 END)")
    return f"({' + '.join(terms)}) % 2 = 1"


@query("region_all", sql(RGB_SQL, f"SELECT {FIELDS} FROM px"))
def _(spark, d):
    return shown(rgb(spark, d).where(regions.whole()))


@query("region_rect", sql(RGB_SQL, f"SELECT {FIELDS} FROM px WHERE {BOX_SQL}"))
def _(spark, d):
    return shown(rgb(spark, d).where(box()))


@query("region_circle", sql(RGB_SQL, f"SELECT {FIELDS} FROM px WHERE {CIRCLE_SQL}"))
def _(spark, d):
    return shown(rgb(spark, d).where(regions.circle(15, 14, 12)))


@query("region_polygon", sql(RGB_SQL, f"SELECT {FIELDS} FROM px WHERE {crossing_sql(POLYGON)}"))
def _(spark, d):
    return shown(rgb(spark, d).where(regions.polygon(POLYGON)))


# Eight customers in a row make one polygon on a 64 x 64 canvas.
VERTICES_SQL = """
corners AS (
  SELECT c_custkey // 8 AS region_id, c_custkey % 8 AS seq,
         CAST(floor(abs(c_acctbal)) AS BIGINT) % 70 - 3 AS x, (c_custkey * 37) % 70 - 3 AS y FROM customer)"""
MASK_SQL = VERTICES_SQL + """,
edges AS (
  SELECT a.region_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM corners a JOIN (SELECT region_id, max(seq) + 1 AS n FROM corners GROUP BY region_id) m USING (region_id)
  JOIN corners b ON b.region_id = a.region_id AND b.seq = (a.seq + 1) % m.n),
canvas AS (SELECT CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x
           FROM (SELECT unnest(range(0, 64)) AS i) CROSS JOIN (SELECT unnest(range(0, 64)) AS j)),
covered AS (
  SELECT region_id, c.y, c.x FROM edges e JOIN canvas c
    ON c.y >= least(y1, y2) AND c.y < greatest(y1, y2)
   AND x1 + CAST(c.y - y1 AS DOUBLE) * (x2 - x1) / (y2 - y1) > c.x
  GROUP BY region_id, c.y, c.x HAVING count(*) % 2 = 1)"""


def outlines(spark, d):
    table = read_table(spark, d, "customer")
    vertex = F.struct(
        (F.col("c_custkey") % 8).alias("seq"),
        (F.floor(F.abs("c_acctbal")).cast("bigint") % 70 - 3).cast("int").alias("x"),
        ((F.col("c_custkey") * 37) % 70 - 3).cast("int").alias("y"))
    return table.groupBy(F.floor(F.col("c_custkey") / 8).alias("region_id")).agg(
        F.sort_array(F.collect_list(vertex)).alias("vertices"))


@query("region_polygon_table", f"WITH {MASK_SQL} SELECT region_id, y, x FROM covered")
def _(spark, d):
    return regions.polygon_mask(regions.polygon_spans(outlines(spark, d), 64, 64))


@query("region_polygon_select", sql_then(GRAY_SQL, MASK_SQL, """
SELECT p.image_id, p.y, p.x, CASE WHEN c.y IS NULL THEN r ELSE 255 - r END AS r,
       CASE WHEN c.y IS NULL THEN g ELSE 255 - g END AS g, CASE WHEN c.y IS NULL THEN b ELSE 255 - b END AS b
FROM px p LEFT JOIN covered c ON c.region_id = p.image_id AND c.y = p.y AND c.x = p.x"""))
def _(spark, d):
    mask = regions.polygon_mask(regions.polygon_spans(outlines(spark, d), 64, 64))
    marked = regions.in_region_table(gray(spark, d), mask.withColumnRenamed("region_id", "image_id"))
    return shown(tone.negative(marked, F.col("selected")))


@query("region_bbox", f"""WITH {VERTICES_SQL}
SELECT region_id, CAST(least(64, greatest(0, min(x))) AS INTEGER) AS x0, CAST(least(64, greatest(0, min(y))) AS INTEGER) AS y0,
       CAST(least(64, greatest(0, max(x) + 1)) AS INTEGER) AS x1, CAST(least(64, greatest(0, max(y) + 1)) AS INTEGER) AS y1
FROM corners GROUP BY region_id""")
def _(spark, d):
    return regions.polygon_bbox(outlines(spark, d), 64, 64)


BOXES_SQL = """
boxes AS (SELECT p_partkey AS region_id, CAST(p_partkey % 30 AS INTEGER) AS x0, CAST(p_partkey % 20 AS INTEGER) AS y0,
                 CAST(p_partkey % 30 + p_size AS INTEGER) AS x1, CAST(p_partkey % 20 + p_size * 2 AS INTEGER) AS y1,
                 100 AS width, 150 AS height FROM part)"""


def boxes(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    return read_table(spark, d, "part").select(
        key.alias("region_id"), (key % 30).cast("int").alias("x0"), (key % 20).cast("int").alias("y0"),
        (key % 30 + size).cast("int").alias("x1"), (key % 20 + size * 2).cast("int").alias("y1"),
        F.lit(100).alias("width"), F.lit(150).alias("height"))


@query("region_rescale", f"""WITH {BOXES_SQL}
SELECT region_id, CAST(x0 * 64 // 100 AS INTEGER) AS x0, CAST(y0 * 48 // 150 AS INTEGER) AS y0,
       CAST(x1 * 64 // 100 AS INTEGER) AS x1, CAST(y1 * 48 // 150 AS INTEGER) AS y1 FROM boxes""")
def _(spark, d):
    return regions.rescale(boxes(spark, d), 64, 48).drop("width", "height")


@query("region_copy", f"""WITH {BOXES_SQL}
SELECT region_id, c_custkey AS image_id, CAST(x0 * (10 + c_nationkey) // 100 AS INTEGER) AS x0, CAST(y0 * (20 + c_nationkey) // 150 AS INTEGER) AS y0,
       CAST(x1 * (10 + c_nationkey) // 100 AS INTEGER) AS x1, CAST(y1 * (20 + c_nationkey) // 150 AS INTEGER) AS y1
FROM boxes JOIN customer ON c_custkey = region_id""")
def _(spark, d):
    targets = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("image_id"), (F.col("c_nationkey") + 10).alias("dst_w"),
        (F.col("c_nationkey") + 20).alias("dst_h"))
    joined = boxes(spark, d).join(targets, F.col("region_id") == F.col("image_id"))
    return regions.rescale(joined, F.col("dst_w"), F.col("dst_h")).select(
        "region_id", "image_id", "x0", "y0", "x1", "y1")


@query("get_area", f"""WITH {BOXES_SQL}
SELECT region_id, x0, y0, x1 - x0 AS width, y1 - y0 AS height FROM boxes""")
def _(spark, d):
    return catalog.get_area(boxes(spark, d))


@query("pick_pixel", sql_then(ARGB_SQL, """
points AS (SELECT DISTINCT l_orderkey // 1024 AS image_id, CAST(l_partkey % 40 AS INTEGER) AS y, CAST(l_suppkey % 40 AS INTEGER) AS x FROM lineitem)""", """
SELECT q.image_id, q.y, q.x, a, r, g, b FROM points q JOIN px USING (image_id, y, x)"""))
def _(spark, d):
    points = read_table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1024).alias("image_id"), (F.col("l_partkey") % 40).cast("int").alias("y"),
        (F.col("l_suppkey") % 40).cast("int").alias("x"))
    return shown(regions.pick_pixels(argb(spark, d), points), "a")


@query("apply_in_region", each_sql(RGB_SQL, "255 - {c}", where=CIRCLE_SQL))
def _(spark, d):
    return shown(tone.negative(rgb(spark, d), regions.circle(15, 14, 12)))


@query("process", each_sql(RGB_SQL, "least(255, {c} * (1000 + 100) // 1000)", where=BOX_SQL))
def _(spark, d):
    return shown(process(rgb(spark, d), "brightness", amount=0.1, region=box()))


def framed_sql(source: str) -> str:
    return sql_then(source, GRID_SQL.format(w="60", h="50", most=64), """
SELECT g.image_id, g.y, g.x, """ + ", ".join(
        f"""CAST(CASE WHEN p.x IS NOT NULL THEN (30 * p.r + 59 * p.g + 11 * p.b) // 100
       WHEN (g.x - 8 + 60) % 60 >= 11 AND (g.x - 8 + 60) % 60 < 49
        AND (g.y + 4) % 50 >= 6 AND (g.y + 4) % 50 < 44 THEN 255 ELSE 0 END AS INTEGER) AS {c}""" for c in "rgb") + """
FROM grid g LEFT JOIN px p ON p.image_id = g.image_id AND p.x = (g.x - 8 + 60) % 60 - 14 AND p.y = (g.y + 4) % 50 - 9""")


def framing():
    return frame_recipe(32, 32, 60, 50, border=3, left_share=80, bottom_share=75)


@query("recipe", framed_sql(RGB_SQL))
def _(spark, d):
    return shown(recipe(rgb(spark, d), framing()))


@query("recipe_batch", sql(RGB_SQL, """
SELECT image_id, 29 - (y - 2) AS y, x - 1 AS x, 255 - r AS r, 255 - g AS g, 255 - b AS b FROM px
WHERE x >= 1 AND x < 31 AND y >= 2 AND y < 32"""))
def _(spark, d):
    steps = [("CROP", dict(x0=1, y0=2, x1=31, y1=32)), ("NEGATIVE", {}), ("FLIPY", {})]
    return shown(recipe(rgb(spark, d), steps))


@query("save_truecolor", sql(ARGB_SQL, "SELECT image_id, width, height, y, x, a, r, g, b FROM px"))
def _(spark, d):
    """Write, then read back."""
    path = fresh_path(spark)
    files.save_truecolor(argb(spark, d), path)
    return as_pixels(files.load_pixels(spark, path))


@query("save_indexed", sql_then(RGB_SQL, POPULAR_SQL.format(n=8) + f""",
pens AS ({nearest_sql("px")})""", """
SELECT n.image_id, n.y, n.x, n.pen, q.r, q.g, q.b FROM pens n JOIN palette q ON q.image_id = n.image_id AND q.pen = n.pen"""))
def _(spark, d):
    """Write pens and palettes, read both back and look the colours up."""
    path = fresh_path(spark)
    indexed, palettes = quantize.render_indexed(rgb(spark, d), 8)
    files.save_indexed(indexed, palettes, path)
    return quantize.expand_indexed(
        spark.read.parquet(f"{path}/indexed_pixels"), spark.read.parquet(f"{path}/palettes")
    ).select("image_id", "y", "x", "pen", "r", "g", "b")


@query("strips", sql(GRAY_SQL, f"""
SELECT image_id, y, len(v) AS n, v[1] AS first_v, v[64] AS last_v FROM (SELECT image_id, y, list(r ORDER BY x) AS v FROM px GROUP BY image_id, y)"""))
def _(spark, d):
    strips = files.to_strips(gray(spark, d))
    return strips.select(
        "image_id", "y", F.size("r").cast("bigint").alias("n"), F.col("r")[0].cast("int").alias("first_v"),
        F.col("r")[63].cast("int").alias("last_v"))
