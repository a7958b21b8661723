"""Frame housekeeping, colour space checks and named attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, combine
from ..sources.tables import read_table
from .core import RGB_SQL, query, rgb, sql

# The catalogue of these queries: one frame per customer.
IMAGES_SQL = """
images AS (
  SELECT c_custkey AS image_id, c_name AS name, CAST(8 + c_custkey % 90 AS INTEGER) AS width,
         CAST(6 + c_nationkey AS INTEGER) AS height,
         (['GRAY', 'RGB', 'ARGB', 'LUT'])[c_nationkey % 4 + 1] AS colorspace
  FROM customer)"""


def images(spark, d):
    table = read_table(spark, d, "customer")
    spaces = F.lit(["GRAY", "RGB", "ARGB", "LUT"])
    return table.select(
        F.col("c_custkey").alias("image_id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 90 + 8).cast("int").alias("width"),
        (F.col("c_nationkey") + 6).cast("int").alias("height"),
        spaces[F.col("c_nationkey") % 4].alias("colorspace"))


@query("frame_info_catalogue", f"""WITH {IMAGES_SQL}
SELECT image_id, name, width, height, colorspace, CASE colorspace WHEN 'ARGB' THEN 4 WHEN 'RGB' THEN 3 ELSE 1 END AS components,
       width * CASE colorspace WHEN 'ARGB' THEN 4 WHEN 'RGB' THEN 3 ELSE 1 END AS bytes_per_row
FROM images""")
def _(spark, d):
    df = images(spark, d)
    components = F.when(F.col("colorspace") == "ARGB", 4).when(F.col("colorspace") == "RGB", 3).otherwise(1)
    return df.withColumn("components", components).withColumn(
        "bytes_per_row", F.col("width") * F.col("components"))


@query("colorspace_guard", f"""WITH {IMAGES_SQL},
wanted AS (SELECT *, image_id % 16 AS mask,
                  CASE colorspace WHEN 'GRAY' THEN 1 WHEN 'RGB' THEN 2 WHEN 'LUT' THEN 4 ELSE 8 END AS bit FROM images)
SELECT image_id, colorspace, concat_ws(',', CASE WHEN mask & 1 <> 0 THEN 'GRAY' END, CASE WHEN mask & 2 <> 0 THEN 'RGB' END,
       CASE WHEN mask & 4 <> 0 THEN 'LUT' END, CASE WHEN mask & 8 <> 0 THEN 'ARGB' END) AS accepts
FROM wanted WHERE mask & bit = 0""")
def _(spark, d):
    mask = (F.col("image_id") % 16).cast("int")
    rejected = catalog.colorspace_guard(images(spark, d), mask)
    return rejected.select("image_id", "colorspace", catalog.colorspace_names(mask).alias("accepts"))


# Attributes come from events: user -> frame, event type -> name, time -> order.
ATTRS_SQL = """
attrs AS (SELECT user_id AS image_id, event_type AS name, 'FLOAT' AS kind, CAST(NULL AS VARCHAR) AS v_str,
                 CAST(NULL AS BIGINT) AS v_long, value AS v_float, event_id AS seq FROM events)"""


def attrs(spark, d):
    return read_table(spark, d, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("name"),
        F.lit("FLOAT").alias("kind"), F.lit(None).cast("string").alias("v_str"),
        F.lit(None).cast("bigint").alias("v_long"), F.col("value").alias("v_float"),
        F.col("event_id").alias("seq"))


LAST_SQL = ATTRS_SQL + """,
changes AS (SELECT c_custkey AS image_id, 'Author' AS name, 'CSTRING' AS kind, c_name AS v_str, CAST(NULL AS BIGINT) AS v_long,
                   CAST(NULL AS DOUBLE) AS v_float, c_custkey AS seq FROM customer),
latest AS (
  SELECT image_id, name, kind, v_str, v_long, v_float, seq
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id, name ORDER BY seq DESC) AS rn
        FROM (SELECT * FROM attrs UNION ALL SELECT * FROM changes)) WHERE rn = 1)"""


def latest(spark, d):
    changes = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("image_id"), F.lit("Author").alias("name"), F.lit("CSTRING").alias("kind"),
        F.col("c_name").alias("v_str"), F.lit(None).cast("bigint").alias("v_long"),
        F.lit(None).cast("double").alias("v_float"), F.col("c_custkey").alias("seq"))
    return catalog.set_attr(attrs(spark, d), changes)


@query("set_attr", f"WITH {LAST_SQL} SELECT * FROM latest")
def _(spark, d):
    return latest(spark, d)


@query("find_attr", f"""WITH {LAST_SQL}
SELECT c.c_custkey AS image_id, 'click' AS name, l.v_float, l.seq
FROM customer c LEFT JOIN latest l ON l.image_id = c.c_custkey AND l.name = 'click'""")
def _(spark, d):
    wanted = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("image_id"), F.lit("click").alias("name"))
    return catalog.find_attr(latest(spark, d), wanted).select("image_id", "name", "v_float", "seq")


@query("remove_attr", f"""WITH {LAST_SQL}
SELECT image_id, name, seq FROM latest WHERE NOT (name = 'error' AND image_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12))""")
def _(spark, d):
    doomed = read_table(spark, d, "customer").where("c_nationkey < 12").select(
        F.col("c_custkey").alias("image_id"), F.lit("error").alias("name"))
    return catalog.remove_attr(latest(spark, d), doomed).select("image_id", "name", "seq")


@query("attr_map", f"""WITH {LAST_SQL}
SELECT image_id, count(*) AS n, max(v_str) FILTER (name = 'Author') AS author FROM latest GROUP BY image_id""")
def _(spark, d):
    maps = catalog.attr_map(latest(spark, d))
    return maps.select(
        "image_id", F.size("attrs").cast("bigint").alias("n"), F.col("attrs")["Author"].alias("author"))


@query("escape_attr", r"""
SELECT conv_id, turn, replace(replace(text || chr(92) || 'n' || chr(10), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') AS escaped
FROM conversations""")
def _(spark, d):
    table = read_table(spark, d, "conversations")
    raw = F.concat(F.col("text"), F.lit("\\n\n"))
    return table.select("conv_id", "turn", catalog.escape_attr(raw).alias("escaped"))


@query("unescape_attr", r"""
SELECT conv_id, turn, text || chr(92) || 'n' || chr(10) || 'end' AS plain FROM conversations""")
def _(spark, d):
    table = read_table(spark, d, "conversations")
    raw = F.concat(F.col("text"), F.lit("\\n\n"))
    coded = F.concat(catalog.escape_attr(raw), F.lit("\\rend"))
    return table.select("conv_id", "turn", catalog.unescape_attr(coded).alias("plain"))


@query("copy_frame", f"""WITH {IMAGES_SQL}
SELECT image_id, name, width, height, colorspace, CAST(NULL AS BIGINT) AS parent_id FROM images
UNION ALL
SELECT image_id + 1000000, name, width, height, colorspace, image_id FROM images WHERE colorspace = 'RGB'""")
def _(spark, d):
    df = images(spark, d)
    return catalog.copy_frame(df, df.where("colorspace = 'RGB'"), 1_000_000)


@query("rename_frame", f"""WITH {IMAGES_SQL}
SELECT i.image_id, coalesce(s.s_name, i.name) AS name FROM images i LEFT JOIN supplier s ON s.s_suppkey = i.image_id""")
def _(spark, d):
    names = read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("new_name"))
    return catalog.rename_frame(images(spark, d), names).select("image_id", "name")


@query("delete_frame", sql(RGB_SQL, """
SELECT image_id, y, x, r, g, b FROM px WHERE image_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey >= 12)"""))
def _(spark, d):
    doomed = read_table(spark, d, "customer").where("c_nationkey >= 12").select(
        F.col("c_custkey").alias("image_id"))
    return catalog.delete_frame(rgb(spark, d), doomed).select("image_id", "y", "x", "r", "g", "b")


@query("find_frame", f"""WITH {IMAGES_SQL}
SELECT image_id, name, width, height FROM images WHERE name = (SELECT c_name FROM customer WHERE c_custkey = 17)""")
def _(spark, d):
    df = images(spark, d)
    return catalog.find_frame(df, df.where("image_id = 17")).select("image_id", "name", "width", "height")


@query("attach_frames", f"""WITH {IMAGES_SQL},
pairs AS (SELECT o_custkey AS dst_id, o_orderkey % 700 AS src_id, o_orderkey AS seq FROM orders)
SELECT dst_id, src_id, seq, width AS src_width, height AS src_height FROM pairs JOIN images ON image_id = src_id""")
def _(spark, d):
    pairs = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("dst_id"), (F.col("o_orderkey") % 700).alias("src_id"),
        F.col("o_orderkey").alias("seq"))
    return combine.attach_frames(pairs, images(spark, d)).select(
        "dst_id", "src_id", "seq", "src_width", "src_height")
