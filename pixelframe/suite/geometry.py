"""Coordinate remaps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tone
from ..layout import heads
from ..operators import geometry
from .core import (
    ARGB_SQL, GRAY_SQL, RGB_SQL, argb, gray, gray_images, query, rgb, shown, sql, sql_then,
)

GRID_SQL = """
sizes AS (SELECT DISTINCT image_id, width, height FROM px),
grid AS (
  SELECT image_id, width, height, {w} AS nw, {h} AS nh, ys.i AS y, xs.i AS x
  FROM sizes, (SELECT CAST(unnest(range(0, {most})) AS INTEGER) AS i) ys,
       (SELECT CAST(unnest(range(0, {most})) AS INTEGER) AS i) xs
  WHERE ys.i < {h} AND xs.i < {w})"""


def gather_sql(source: str, w: str, h: str, most: int, sx: str, sy: str,
               missing: tuple[str, str] = ("0", "0"), extra: str = "") -> str:
    """Every destination cell reads the source cell (sx, sy), if it exists."""
    fill, alpha = missing
    return sql_then(source, GRID_SQL.format(w=w, h=h, most=most) + extra, f"""
SELECT g.image_id, g.y, g.x, CASE WHEN p.x IS NULL THEN {alpha} ELSE p.a END AS a,
       coalesce(p.r, {fill}) AS r, coalesce(p.g, {fill}) AS g, coalesce(p.b, {fill}) AS b
FROM grid g LEFT JOIN px p ON p.image_id = g.image_id AND p.x = {sx} AND p.y = {sy}""")


@query("crop", sql(ARGB_SQL, """
SELECT image_id, y - 7 AS y, x - 5 AS x, a, r, g, b FROM px WHERE x >= 5 AND x < 21 AND y >= 7 AND y < 29"""))
def _(spark, d):
    return shown(geometry.crop(argb(spark, d), 5, 7, 21, 29), "a")


LINES_CUT_SQL = """
cut AS (SELECT image_id, width, height, y, x, a,
               CASE WHEN r < 200 THEN 0 ELSE 255 END AS r, CASE WHEN g < 200 THEN 0 ELSE 255 END AS g,
               CASE WHEN b < 200 THEN 0 ELSE 255 END AS b FROM px)"""
AUTOCROP_SQL = LINES_CUT_SQL + """,
corner AS (SELECT image_id, r AS cr, g AS cg, b AS cb FROM cut WHERE x = 0 AND y = 0),
box AS (
  SELECT c.image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1
  FROM cut c JOIN corner k ON c.image_id = k.image_id AND (c.r <> cr OR c.g <> cg OR c.b <> cb)
  GROUP BY c.image_id)"""


def cut(spark, d):
    """Gray rasters reduced to sparse white dots, so that borders exist."""
    return tone.threshold_channel(gray(spark, d), 200)


@query("content_bbox", sql_then(GRAY_SQL, AUTOCROP_SQL, """
SELECT image_id, x0, y0, x1, y1 FROM box"""))
def _(spark, d):
    from ..operators import stats
    return stats.content_bbox(cut(spark, d), gray_images(spark, d))


@query("autocrop", sql_then(GRAY_SQL, AUTOCROP_SQL + """,
target AS (
  SELECT b.*, cr, cg, cb, x1 - x0 + 6 AS w, y1 - y0 + 4 AS h FROM box b JOIN corner USING (image_id)),
frames AS (
  SELECT t.*, CAST(yy.i AS INTEGER) AS y, CAST(xx.i AS INTEGER) AS x
  FROM target t, (SELECT unnest(range(0, 80)) AS i) yy, (SELECT unnest(range(0, 80)) AS i) xx
  WHERE yy.i < h AND xx.i < w)""", """
SELECT t.image_id, t.y, t.x, coalesce(c.r, cr) AS r, coalesce(c.g, cg) AS g, coalesce(c.b, cb) AS b
FROM frames t LEFT JOIN cut c ON c.image_id = t.image_id AND c.y = t.y + y0 - 2
     AND c.x = t.x + x0 - 3 AND t.x >= 3 AND t.x < w - 3
UNION ALL
SELECT image_id, y, x, r, g, b FROM cut WHERE image_id NOT IN (SELECT image_id FROM box)"""))
def _(spark, d):
    return shown(geometry.autocrop(cut(spark, d), 3, 2, gray_images(spark, d)))


def centred(fill: str, alpha: str) -> str:
    return gather_sql(ARGB_SQL, "45", "40", 64, "g.x - (45 - 32) // 2", "g.y - (40 - 32) // 2", (fill, alpha))


@query("resize_black", centred("0", "0"))
def _(spark, d):
    return shown(geometry.resize_canvas(argb(spark, d), 45, 40, "black"), "a")


@query("resize_white", centred("255", "255"))
def _(spark, d):
    return shown(geometry.resize_canvas(argb(spark, d), 45, 40, "white"), "a")


@query("resize_background", sql_then(RGB_SQL, """
bg AS (SELECT image_id, sum(r) // 4 AS br, sum(g) // 4 AS bgr, sum(b) // 4 AS bb
       FROM px WHERE x IN (0, 31) AND y IN (0, 31) GROUP BY image_id),""" + GRID_SQL.format(w="45", h="40", most=64), """
SELECT g.image_id, g.y, g.x, CAST(coalesce(p.r, br) AS INTEGER) AS r,
       CAST(coalesce(p.g, bgr) AS INTEGER) AS g, CAST(coalesce(p.b, bb) AS INTEGER) AS b
FROM grid g JOIN bg USING (image_id)
LEFT JOIN px p ON p.image_id = g.image_id AND p.x = g.x - 6 AND p.y = g.y - 4"""))
def _(spark, d):
    return shown(geometry.resize_canvas(rgb(spark, d), 45, 40, "background"))


@query("resize_border", gather_sql(
    ARGB_SQL, "45", "40", 64, "least(31, greatest(0, g.x - 6))", "least(31, greatest(0, g.y - 4))"))
def _(spark, d):
    return shown(geometry.resize_canvas(argb(spark, d), 45, 40, "border"), "a")


@query("shift", gather_sql(ARGB_SQL, "32", "32", 32, "g.x - 5", "g.y + 9"))
def _(spark, d):
    return shown(geometry.shift(argb(spark, d), 5, -9), "a")


@query("roll", gather_sql(ARGB_SQL, "32", "32", 32, "((g.x + 45) % 32 + 32) % 32", "((g.y - 7) % 32 + 32) % 32"))
def _(spark, d):
    return shown(geometry.roll(argb(spark, d), -45, 7), "a")


@query("flip_x", gather_sql(RGB_SQL, "32", "32", 32, "31 - g.x", "g.y", ("0", "NULL")))
def _(spark, d):
    return shown(geometry.flip_x(rgb(spark, d)), "a")


@query("flip_y", gather_sql(RGB_SQL, "32", "32", 32, "g.x", """CASE WHEN g.x >= 3 AND g.x < 20
       AND g.y >= 4 AND g.y < 30 THEN 33 - g.y ELSE g.y END""", ("0", "NULL")))
def _(spark, d):
    return shown(geometry.flip_y(rgb(spark, d), (3, 4, 20, 30)), "a")


def slant(angle: int, size: int = 32) -> int:
    return int(math.tan(math.pi * angle / 180.0) * size)


@query("shear_h", gather_sql(
    ARGB_SQL, str(32 + slant(20)), "32", 64,
    f"g.x - ({slant(20)} - ({slant(20)} * g.y) // 32)", "g.y"))
def _(spark, d):
    return shown(geometry.shear_h(argb(spark, d), 20), "a")


@query("shear_v", gather_sql(
    ARGB_SQL, "32", str(32 - slant(-35)), 64,
    "g.x", f"g.y - ({-slant(-35)} * (31 - g.x)) // 32"))
def _(spark, d):
    return shown(geometry.shear_v(argb(spark, d), -35), "a")


def rotation_sql(angle: int, side: int) -> dict[str, str]:
    t = math.pi * angle / 180.0
    c, s = math.cos(t), math.sin(t)
    if 0 <= angle <= 90 or angle < -90:
        w, h = abs(side * c) + abs(side * s), abs(side * s + side * c)
    else:
        w, h = abs(side * c - side * s), abs(side * s) + abs(side * c)
    nw, nh = int(w + 0.5), int(h + 0.5)
    u, v = f"(g.x - {(nw - 1) / 2.0!r}::DOUBLE)", f"(g.y - {(nh - 1) / 2.0!r}::DOUBLE)"
    mid = f"{(side - 1) / 2.0!r}::DOUBLE"
    cl, sl = f"{c!r}::DOUBLE", f"{s!r}::DOUBLE"
    return {
        "nw": str(nw), "nh": str(nh), "most": str(max(nw, nh)),
        "sx": f"({u} * {cl} + {v} * {sl} + {mid})",
        "sy": f"({v} * {cl} - {u} * {sl} + {mid})",
    }


def inside_sql(side: int) -> str:
    return f"sx >= -0.49 AND sy >= -0.49 AND sx <= {side - 1} AND sy <= {side - 1}"


def rotate_nn_sql(angle: int) -> str:
    r = rotation_sql(angle, 32)
    grid = GRID_SQL.format(w=r["nw"], h=r["nh"], most=r["most"])
    return sql_then(ARGB_SQL, grid + f""",
mapped AS (SELECT g.image_id, g.y, g.x, {r['sx']} AS sx, {r['sy']} AS sy FROM grid g)""", f"""
SELECT m.image_id, m.y, m.x, coalesce(p.a, 0) AS a, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b
FROM mapped m LEFT JOIN px p ON {inside_sql(32)} AND p.image_id = m.image_id
     AND p.x = CAST(floor(sx + 0.5) AS INTEGER) AND p.y = CAST(floor(sy + 0.5) AS INTEGER)""")


TAPS_SQL = """
taps AS (
  SELECT image_id, y, x, CAST(greatest(0, least({last}, floor(sx) + i)) AS INTEGER) AS qx,
         CAST(greatest(0, least({last}, floor(sy) + j)) AS INTEGER) AS qy,
         CASE WHEN i = 1 THEN kx ELSE 256 - kx END * CASE WHEN j = 1 THEN ky ELSE 256 - ky END AS k
  FROM (SELECT *, CAST(floor((sx - floor(sx)) * 256) AS INTEGER) AS kx,
               CAST(floor((sy - floor(sy)) * 256) AS INTEGER) AS ky FROM mapped WHERE {inside})
       CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)),
blend AS (
  SELECT t.image_id, t.y, t.x, {sums}
  FROM taps t JOIN px p ON p.image_id = t.image_id AND p.x = t.qx AND p.y = t.qy
  GROUP BY t.image_id, t.y, t.x)"""


def taps_sql(side: int, channels: str) -> str:
    sums = ", ".join(f"CAST(sum(p.{c} * k) // 65536 AS INTEGER) AS {c}" for c in channels)
    return TAPS_SQL.format(last=side - 1, inside=inside_sql(side), sums=sums)


def rotate_bilinear_sql(angle: int) -> str:
    r = rotation_sql(angle, 32)
    grid = GRID_SQL.format(w=r["nw"], h=r["nh"], most=r["most"])
    return sql_then(ARGB_SQL, grid + f""",
mapped AS (SELECT g.image_id, g.y, g.x, {r['sx']} AS sx, {r['sy']} AS sy FROM grid g),"""
                    + taps_sql(32, "argb"), """
SELECT m.image_id, m.y, m.x, coalesce(b.a, 0) AS a, coalesce(b.r, 0) AS r,
       coalesce(b.g, 0) AS g, coalesce(b.b, 0) AS b
FROM mapped m LEFT JOIN blend b ON b.image_id = m.image_id AND b.y = m.y AND b.x = m.x""")


@query("rotate_nn", rotate_nn_sql(25))
def _(spark, d):
    return shown(geometry.rotate_nn(argb(spark, d), 25), "a")


@query("rotate_nn_obtuse", rotate_nn_sql(-140))
def _(spark, d):
    return shown(geometry.rotate_nn(argb(spark, d), -140), "a")


@query("rotate_bilinear", rotate_bilinear_sql(-33))
def _(spark, d):
    return shown(geometry.rotate_bilinear(argb(spark, d), -33), "a")


TWIRL = dict(angle=130, radius=24, cx=30, cy=36)


def twirl_map_sql() -> str:
    turn = f"({math.pi * 130 / 180.0!r}::DOUBLE * (1.0::DOUBLE - sqrt(dx * dx + dy * dy) / 24))"
    return f""",
polar AS (SELECT *, CAST(x - 30 AS DOUBLE) AS dx, CAST(y - 36 AS DOUBLE) AS dy FROM px),
turned AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, {turn} AS t FROM polar),
mapped AS (
  SELECT *, floor((dx * cos(t) + dy * sin(t) + 30) * 4096 + 0.5) / 4096 AS sx,
         floor((dy * cos(t) - dx * sin(t) + 36) * 4096 + 0.5) / 4096 AS sy
  FROM turned WHERE dist < 24)"""


@query("twirl_nn", f"""WITH {GRAY_SQL.strip()}{twirl_map_sql()}
SELECT image_id, y, x, r, g, b FROM turned WHERE dist >= 24
UNION ALL
SELECT m.image_id, m.y, m.x, coalesce(p.r, 0), coalesce(p.g, 0), coalesce(p.b, 0)
FROM mapped m LEFT JOIN px p ON {inside_sql(64)} AND p.image_id = m.image_id
     AND p.x = CAST(floor(sx + 0.5) AS INTEGER) AND p.y = CAST(floor(sy + 0.5) AS INTEGER)""")
def _(spark, d):
    return shown(geometry.twirl_nn(gray(spark, d), **TWIRL))


@query("twirl_bilinear", f"""WITH {GRAY_SQL.strip()}{twirl_map_sql()},{taps_sql(64, "rgb")}
SELECT image_id, y, x, r, g, b FROM turned WHERE dist >= 24
UNION ALL
SELECT m.image_id, m.y, m.x, coalesce(b.r, 0), coalesce(b.g, 0), coalesce(b.b, 0)
FROM mapped m LEFT JOIN blend b ON b.image_id = m.image_id AND b.y = m.y AND b.x = m.x""")
def _(spark, d):
    return shown(geometry.twirl_bilinear(gray(spark, d), **TWIRL))


@query("scale_quick", gather_sql(ARGB_SQL, "50", "19", 64, "(g.x * 32) // 50", "(g.y * 32) // 19"))
def _(spark, d):
    return shown(geometry.scale_quick(argb(spark, d), 50, 19), "a")


@query("thumbnail", gather_sql(GRAY_SQL, "20", "12", 64, "(g.x * 64) // 20", "(g.y * 64) // 12"))
def _(spark, d):
    return shown(geometry.thumbnail(gray(spark, d), 20, 12), "a")


def average_pass_sql(name: str, source: str, axis: str, other: str, old: int, new: int) -> str:
    step, end = new * 4096 // old, new * 4096
    chans = ", ".join(f"CAST(least(255, (sum({c} * k) + 2048) // 4096) AS INTEGER) AS {c}" for c in "argb")
    return f"""
{name} AS (
  SELECT image_id, j AS {axis}, {other}, {chans}
  FROM (SELECT *, least(CASE WHEN {axis} = {old - 1} THEN {end} ELSE ({axis} + 1) * {step} END, (j + 1) * 4096)
               - greatest({axis} * {step}, j * 4096) AS k
        FROM {source} CROSS JOIN (SELECT CAST(unnest(range(0, {new})) AS INTEGER) AS j)) w
  WHERE k > 0 GROUP BY image_id, j, {other})"""


@query("scale_average", sql_then(
    ARGB_SQL, average_pass_sql("tall", "px", "y", "x", 32, 21) + ","
    + average_pass_sql("wide", "tall", "x", "y", 32, 47),
    "SELECT image_id, y, x, a, r, g, b FROM wide"))
def _(spark, d):
    return shown(geometry.scale_average(argb(spark, d), 47, 21), "a")


IMAGES_SQL = """
images AS (SELECT p_partkey AS image_id, 100 + p_size * 7 AS width, 80 + p_size * 5 AS height,
                  72 + p_size AS dpi_x, 60 + p_size AS dpi_y FROM part)"""
UNITS_SQL = """
       100.0 * new_width / width AS percent_x, 100.0 * new_height / height AS percent_y,
       2.54 * CAST(new_width AS DOUBLE) / dpi_x AS mm_x, 2.54 * CAST(new_height AS DOUBLE) / dpi_y AS mm_y"""


def catalogue(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("image_id"), (size * 7 + 100).alias("width"),
        (size * 5 + 80).alias("height"), (size + 72).alias("dpi_x"), (size + 60).alias("dpi_y"))


@query("scale_units", f"""WITH {IMAGES_SQL},
sized AS (SELECT *, CAST(floor(CAST(62.5 AS DOUBLE) * width / 100.0) AS INTEGER) AS new_width FROM images),
full_size AS (SELECT *, CAST((new_width * height) // width AS INTEGER) AS new_height FROM sized)
SELECT image_id, new_width, new_height, CAST(100.0 AS DOUBLE) * new_width / width AS percent_x,
       CAST(100.0 AS DOUBLE) * new_height / height AS percent_y,
       CAST(2.54 AS DOUBLE) * new_width / dpi_x AS mm_x, CAST(2.54 AS DOUBLE) * new_height / dpi_y AS mm_y
FROM full_size""")
def _(spark, d):
    out = geometry.scale_units(catalogue(spark, d), percent=(62.5, 100.0), keep_aspect=True)
    return out.drop("width", "height", "dpi_x", "dpi_y")


@query("scale_units_mm", f"""WITH {IMAGES_SQL}
SELECT image_id, CAST(floor(CAST(dpi_x AS DOUBLE) * 12.5 / 2.54) AS INTEGER) AS new_width,
       CAST(floor(CAST(dpi_y AS DOUBLE) * 9.0 / 2.54) AS INTEGER) AS new_height FROM images""")
def _(spark, d):
    out = geometry.scale_units(catalogue(spark, d), millimetres=(12.5, 9.0))
    return out.select("image_id", "new_width", "new_height")


@query("scale_to_units", sql_then(RGB_SQL, GRID_SQL.format(w="24", h="24", most=32), """
SELECT g.image_id, g.y, g.x, p.r, p.g, p.b FROM grid g
JOIN px p ON p.image_id = g.image_id AND p.x = (g.x * 32) // 24 AND p.y = (g.y * 32) // 24"""))
def _(spark, d):
    df = rgb(spark, d)
    w = F.floor(F.col("width") * 75 / 100).cast("int")
    h = F.floor(F.col("height") * 75 / 100).cast("int")
    return shown(geometry.scale_quick(df, w, h))


@query("first_pixels", sql(ARGB_SQL, "SELECT image_id, a, r, g, b FROM px WHERE x = 0 AND y = 0"))
def _(spark, d):
    return heads(argb(spark, d)).select("image_id", "a", "r", "g", "b")
