"""Operators on two rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..layout import heads
from ..plans.registry import process
from ..operators import combine, cutpaste, watermark
from ..sources.tables import read_table
from .core import (
    ARGB_SQL, GRAY_SQL, RGB_SQL, argb, gray, query, rgb, rgb_images, shown, sql, sql_then,
)
from .points import BOX_SQL, box

# Each 32 x 32 frame gets the next frame (with alpha) of the same collection,
# placed at a corner that depends on its number.
PAIRS_SQL = """
pairs AS (SELECT DISTINCT image_id AS dst_id, image_id + 1 AS src_id, CAST(image_id % 9 - 4 AS INTEGER) AS top,
                 CAST(image_id % 7 * 3 - 8 AS INTEGER) AS "left" FROM px)"""


def pairs(df):
    key = F.col("image_id")
    return heads(df).select(
        key.alias("dst_id"), (key + 1).alias("src_id"), (key % 9 - 4).cast("int").alias("top"),
        (key % 7 * 3 - 8).cast("int").alias("left"))


BLEND_SQL = {
    "direct": "s.{c}",
    "minimum": "CASE WHEN d.r * d.r + d.g * d.g + d.b * d.b > s.r * s.r + s.g * s.g + s.b * s.b THEN s.{c} ELSE d.{c} END",
    "maximum": "CASE WHEN d.r * d.r + d.g * d.g + d.b * d.b < s.r * s.r + s.g * s.g + s.b * s.b THEN s.{c} ELSE d.{c} END",
    "mix": "(90 * s.{c} + (255 - 90) * d.{c}) // 255",
    "transparent_black": "CASE WHEN s.r > 0 OR s.g > 0 OR s.b > 0 THEN s.{c} ELSE d.{c} END",
    "add": "least(255, s.{c} + d.{c})",
    "subtract": "greatest(0, d.{c} - s.{c})",
    "multiply": "d.{c} * s.{c} // 256",
}


def composite_sql(method: str, alpha: bool, on: str | None = None) -> str:
    on = on or 's.image_id = p.src_id AND s.y = d.y - p.top AND s.x = d.x - p."left"'
    cols = []
    for c in "rgb":
        new = "(" + BLEND_SQL[method].format(c=c) + ")"
        if alpha:
            new = f"((255 - s.a) * {new} + s.a * d.{c}) // 256"
        cols.append(f"CAST(CASE WHEN s.r IS NULL THEN d.{c} ELSE {new} END AS INTEGER) AS {c}")
    return sql_then(ARGB_SQL if alpha else RGB_SQL, PAIRS_SQL, f"""
SELECT d.image_id, d.y, d.x, {', '.join(cols)}
FROM px d JOIN pairs p ON p.dst_id = d.image_id LEFT JOIN px s ON {on}""")


def composite(df, method, rows=None):
    return combine.composite(df, combine.place(df, pairs(df), rows), method, 90)


def _register(method: str) -> None:
    @query(f"composite_{method}", composite_sql(method, False))
    def _(spark, d):
        return shown(composite(rgb(spark, d), method, rgb_images(spark, d)))


for _method in combine.METHODS:
    _register(_method)


@query("composite_alpha", composite_sql("mix", True))
def _(spark, d):
    return shown(composite(argb(spark, d), "mix"))


@query("process_composite", composite_sql("mix", False))
def _(spark, d):
    df = rgb(spark, d)
    return shown(process(df, "composite", source=df, pairs=pairs(df), method="mix", ratio=90, rows=rgb_images(spark, d)))


TILE_ON_SQL = """s.image_id = p.src_id AND s.y = ((d.y - p.top) % 32 + 32) % 32
  AND s.x = ((d.x - p."left") % 32 + 32) % 32 AND d.x >= 4 AND d.x < 28 AND d.y >= 6 AND d.y < 27"""


@query("composite_tile", composite_sql("add", False, TILE_ON_SQL))
def _(spark, d):
    df = rgb(spark, d)
    sized = pairs(df).withColumns({"src_width": F.lit(32), "src_height": F.lit(32)})
    return shown(combine.composite_tile(df, df, sized, "add", region=box()))


# A small tile repeated over larger frames: 32 x 32 over 64 x 64.
SMALL_TILE_SQL = ("WITH " + GRAY_SQL.strip().replace("px AS", "big AS").replace("lim AS", "glim AS")
                  .replace("FROM lim", "FROM glim").replace(", lim", ", glim") + ",\n" + ARGB_SQL.strip())


@query("add_alpha_intensity", SMALL_TILE_SQL + """
SELECT d.image_id, d.y, d.x, CAST((s.r + s.g + s.b) // 3 AS INTEGER) AS a, d.r, d.g, d.b
FROM big d LEFT JOIN px s ON s.image_id = d.image_id % 2 AND s.y = d.y % 32 AND s.x = d.x % 32""")
def _(spark, d):
    return shown(_with_alpha(spark, d, "intensity"), "a")


@query("add_alpha_copy", SMALL_TILE_SQL + """
SELECT d.image_id, d.y, d.x, s.a, d.r, d.g, d.b
FROM big d LEFT JOIN px s ON s.image_id = d.image_id % 2 AND s.y = d.y % 32 AND s.x = d.x % 32""")
def _(spark, d):
    return shown(_with_alpha(spark, d, "copy"), "a")


def _with_alpha(spark, d, use):
    df = gray(spark, d)
    links = heads(df).select(
        F.col("image_id").alias("dst_id"), (F.col("image_id") % 2).alias("src_id"),
        F.lit(32).alias("src_width"), F.lit(32).alias("src_height"))
    return combine.add_alpha(df, argb(spark, d), links, use)


CIRCLE_SQL = "(x - 14) * (x - 14) + (y - 17) * (y - 17) <= 100"


@query("cut_to_frame", sql(ARGB_SQL, f"""
SELECT image_id, CAST(y - 7 AS INTEGER) AS y, CAST(x - 4 AS INTEGER) AS x,
       CASE WHEN {CIRCLE_SQL} THEN 0 ELSE 255 END AS a, r, g, b
FROM px WHERE x >= 4 AND x < 25 AND y >= 7 AND y < 28"""))
def _(spark, d):
    return shown(cutpaste.cut_circle(argb(spark, d), 14, 17, 11), "a")


@query("cut_erase", sql(ARGB_SQL, f"""
SELECT image_id, y, x, a, CASE WHEN {BOX_SQL} THEN 0 ELSE r END AS r, CASE WHEN {BOX_SQL} THEN 0 ELSE g END AS g,
       CASE WHEN {BOX_SQL} THEN 0 ELSE b END AS b FROM px"""))
def _(spark, d):
    return shown(cutpaste.cut_erase(argb(spark, d), box()), "a")


@query("paste", sql_then(RGB_SQL, f"""
piece AS (SELECT image_id, y - 7 + 10 AS y, x - 4 + 3 AS x, CASE WHEN {CIRCLE_SQL} THEN 0 ELSE 255 END AS a, r, g, b
          FROM px WHERE x >= 4 AND x < 25 AND y >= 7 AND y < 28)""", """
SELECT d.image_id, d.y, d.x, """ + ", ".join(
    f"CAST(CASE WHEN s.r IS NULL THEN d.{c} ELSE ((255 - s.a) * s.{c} + s.a * d.{c}) // 256 END AS INTEGER) AS {c}"
    for c in "rgb") + """
FROM px d LEFT JOIN piece s ON s.image_id = d.image_id AND s.y = d.y AND s.x = d.x"""))
def _(spark, d):
    df = rgb(spark, d)
    return shown(cutpaste.paste(df, cutpaste.cut_circle(df, 14, 17, 11), top=10, left=3))


# Watermarks: frame i carries the name of customer i.
MARK_SQL = """
lines AS (
  SELECT image_id, y, sha256(string_agg(printf('%02X%02X%02X%02X', a & 254, r & 254, g & 254, b & 254), '' ORDER BY x)) AS digest
  FROM px GROUP BY image_id, y),
keys AS (
  SELECT image_id, sha1('secret' || sha256(string_agg(digest, '' ORDER BY y)) || 'secret') AS k
  FROM lines GROUP BY image_id),
streams AS (
  SELECT k.image_id, k.k, '4DA000' || hex(encode('name.txt')) || '00' || printf('%08X', octet_length(encode(c_name))) || hex(encode(c_name)) AS h
  FROM keys k JOIN customer ON c_custkey = k.image_id),
bits AS (
  SELECT image_id, k, n, (CAST('0x' || substr(h, CAST(n // 8 AS BIGINT) * 2 + 1, 2) AS INTEGER) >> CAST(7 - n % 8 AS INTEGER)) & 1 AS bit
  FROM (SELECT *, unnest(range(0, length(h) * 4)) AS n FROM streams)),
s1 AS (SELECT *, n % 128 AS x0, (n // 128 + (CAST('0x' || substr(sha1(k || ':' || CAST(n % 128 AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647)) % 32 AS y1 FROM bits),
s2 AS (SELECT *, (x0 + (CAST('0x' || substr(sha1(k || ':' || CAST(y1 AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647)) % 128 AS x1 FROM s1),
marks AS (SELECT image_id, bit, x1 // 4 AS x, x1 % 4 AS ch,
                 (y1 + (CAST('0x' || substr(sha1(k || ':' || CAST(x1 AS VARCHAR)), 1, 8) AS BIGINT) & 2147483647)) % 32 AS y FROM s2)"""


def _payloads(spark, d):
    return read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("image_id"), F.lit("name.txt").alias("name"),
        F.encode("c_name", "UTF-8").alias("payload"))


@query("watermark_embed", sql_then(ARGB_SQL, MARK_SQL, """
SELECT p.image_id, p.y, p.x, """ + ", ".join(
    f"CAST(coalesce(({c} & 254) | (SELECT max(m.bit) FROM marks m WHERE m.image_id = p.image_id AND m.y = p.y AND m.x = p.x AND m.ch = {i}), {c}) AS INTEGER) AS {c}"
    for i, c in enumerate("argb")) + " FROM px p"))
def _(spark, d):
    return shown(watermark.embed(
        argb(spark, d), _payloads(spark, d), "secret", "argb", rows=rgb_images(spark, d)), "a")


@query("watermark_extract", sql(ARGB_SQL, """
SELECT c_custkey AS image_id, 'name.txt' AS name, c_name AS payload
FROM customer WHERE c_custkey IN (SELECT image_id FROM px)"""))
def _(spark, d):
    bound = rgb_images(spark, d)
    marked = watermark.embed(argb(spark, d), _payloads(spark, d), "secret", "argb", rows=bound)
    found = watermark.assemble(watermark.extract(marked, "secret", "argb", rows=bound))
    return found.select("image_id", "name", F.decode("payload", "UTF-8").alias("payload"))
