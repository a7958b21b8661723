"""Registry of queries, result projection and the SQL form of the rasters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in ENTRIES:
            raise KeyError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, sql)
        return build

    return register


def shown(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("image_id", "y", "x", *extra, "r", "g", "b")


def rgb(spark: SparkSession, folder: str) -> DataFrame:
    return tables.rgb_from_orders(spark, folder)


def argb(spark: SparkSession, folder: str) -> DataFrame:
    return tables.rgb_from_orders(spark, folder, alpha=True)


def gray(spark: SparkSession, folder: str) -> DataFrame:
    return tables.gray_from_embeddings(spark, folder)


def plot(spark: SparkSession, folder: str) -> DataFrame:
    return tables.bytes_from_documents(spark, folder)


def rgb_images(spark: SparkSession, folder: str) -> int:
    return tables.image_bound(spark, folder, "orders", tables.RGB_CELLS)


def wide_rgb(spark: SparkSession, folder: str) -> DataFrame:
    """For operators that make many rows of one pixel."""
    return tables.rgb_from_orders(spark, folder, wide=True)


def plot_images(spark: SparkSession, folder: str) -> int:
    return tables.image_bound(spark, folder, "documents", 1)


def gray_images(spark: SparkSession, folder: str) -> int:
    return tables.image_bound(spark, folder, "embeddings", tables.GRAY_SIDE)


# --- the same rasters in SQL: each defines the relation px ------------------

ARGB_SQL = """
lim AS (SELECT max(o_orderkey) AS m FROM orders),
flat AS (
  SELECT o_orderkey AS k, (o_orderkey * 36) % 256 AS a,
         CAST(floor(o_totalprice) AS BIGINT) % 256 AS r, o_custkey % 256 AS g,
         (o_custkey * 7 + o_orderkey) % 256 AS b
  FROM orders
  UNION ALL
  SELECT unnest(range(m + 1, (m // 1024 + 1) * 1024)), 0, 0, 0, 0 FROM lim),
px AS (
  SELECT k // 1024 AS image_id, 32 AS width, 32 AS height,
         CAST((k % 1024) // 32 AS INTEGER) AS y, CAST(k % 32 AS INTEGER) AS x,
         CAST(a AS INTEGER) AS a, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g,
         CAST(b AS INTEGER) AS b
  FROM flat)"""
RGB_SQL = ARGB_SQL.replace("CAST(a AS INTEGER) AS a", "CAST(NULL AS INTEGER) AS a")
GRAY_SQL = """
lim AS (SELECT max(vec_id) AS m FROM embeddings),
lines AS (
  SELECT vec_id AS k, embedding FROM embeddings
  UNION ALL
  SELECT unnest(range(m + 1, (m // 64 + 1) * 64)), NULL FROM lim),
cells AS (
  SELECT k, CAST(d.i AS INTEGER) AS x, embedding[d.i + 1] AS e
  FROM lines CROSS JOIN (SELECT unnest(range(0, 64)) AS i) d),
vals AS (
  SELECT k, x, coalesce(CAST(least(255, greatest(0,
           floor(128.0 + 220.0 * CAST(e AS DOUBLE)))) AS INTEGER), 0) AS v
  FROM cells),
px AS (
  SELECT k // 64 AS image_id, 64 AS width, 64 AS height, CAST(k % 64 AS INTEGER) AS y,
         x, CAST(NULL AS INTEGER) AS a, v AS r, v AS g, v AS b
  FROM vals)"""
PLOT_SQL = """
raw AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
tall AS (SELECT doc_id, h, CAST((length(h) // 2 + 63) // 64 AS INTEGER) AS height FROM raw),
lines AS (
  SELECT doc_id, height, y, substr(h, y * 128 + 1, 128) AS s
  FROM (SELECT doc_id, h, height, CAST(unnest(range(0, height)) AS INTEGER) AS y FROM tall)),
cells AS (
  SELECT doc_id, height, y, x, substr(s, x * 2 + 1, 2) AS hx
  FROM (SELECT *, CAST(unnest(range(0, 64)) AS INTEGER) AS x FROM lines)),
vals AS (
  SELECT doc_id, height, y, x,
         CASE WHEN hx = '' THEN 0 ELSE CAST('0x' || hx AS INTEGER) END AS v FROM cells),
px AS (
  SELECT doc_id AS image_id, 64 AS width, height, y, x, CAST(NULL AS INTEGER) AS a,
         v AS r, v AS g, v AS b
  FROM vals)"""


def sql(source: str, body: str) -> str:
    return f"WITH {source.strip()}\n{body.strip()}"


def sql_then(source: str, ctes: str, body: str) -> str:
    return f"WITH {source.strip()},\n{ctes.strip()}\n{body.strip()}"


def clamp_sql(expr: str) -> str:
    return f"CAST(least(255, greatest(0, {expr})) AS INTEGER)"


def point_sql(source: str, r: str, g: str, b: str, a: str | None = None, where: str = "") -> str:
    """SELECT that replaces the channels by the given expressions."""

    def one(expr: str, name: str) -> str:
        body = f"CASE WHEN {where} THEN {expr} ELSE {name} END" if where else expr
        return f"CAST({body} AS INTEGER) AS {name}"

    cols = ["image_id", "y", "x"]
    if a is not None:
        cols.append(one(a, "a"))
    cols += [one(r, "r"), one(g, "g"), one(b, "b")]
    return sql(source, f"SELECT {', '.join(cols)} FROM px")


def each_sql(source: str, template: str, a: str | None = None, where: str = "") -> str:
    """point_sql with one template for the three colours ({c} is the sample)."""
    return point_sql(source, *[template.format(c=c) for c in "rgb"], a=a, where=where)



def dither_sql(source: str, palette: str, channels: str) -> str:
    """Error diffusion as a recursive query: one pixel of every image per step.

    ``palette`` defines the relation palette; lists hold the errors of two lines.
    """
    cs = list(channels)
    each = lambda form, sep=", ": sep.join(form.format(c=c) for c in cs)
    below = (
        "[below_{c}[i] + CASE WHEN i = x + 2 - step THEN 3 * left_{c} WHEN i = x + 2 THEN 5 * left_{c} "
        "WHEN i = x + 2 + step THEN left_{c} ELSE 0 END FOR i IN range(1, w + 3)] AS below_{c}"
    )
    fixed = "image_id, w, h, pal, " + each("line_{c}")
    return f"""WITH RECURSIVE {source.strip()},
{palette.strip()},
pals AS (SELECT image_id, list(struct_pack(pen := pen, r := r, g := g, b := b) ORDER BY pen) AS pal FROM palette GROUP BY image_id),
frames AS (SELECT image_id, CAST(max(width) AS BIGINT) AS w, CAST(max(height) AS BIGINT) AS h,
                  {each('list(CAST({c} AS BIGINT) ORDER BY y, x) AS line_{c}')} FROM px GROUP BY image_id),
walk AS (
  SELECT {fixed}, CAST(-1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS pen,
         {each('[CAST(0 AS BIGINT) FOR i IN range(0, w)] AS carried_{c}, [CAST(0 AS BIGINT) FOR i IN range(0, w + 2)] AS below_{c}, CAST(0 AS BIGINT) AS ahead_{c}')}
  FROM frames JOIN pals USING (image_id)
  UNION ALL
  SELECT {fixed}, n, x, y, pen, {each('carried_{c}, ' + below + ', 7 * left_{c} AS ahead_{c}')}
  FROM (
    SELECT *, {each('want_{c} - pal[pen + 1].{c} AS left_{c}')}
    FROM (
      SELECT *, list_min([({each('(want_{c} - p.{c}) * (want_{c} - p.{c})', ' + ')}) * 1024 + p.pen FOR p IN pal]) % 1024 AS pen
      FROM (
        SELECT *, {each('''greatest(0, least(255, line_{c}[y * w + x + 1] + sign(err_{c})
               * CASE WHEN abs(err_{c}) < 16 THEN abs(err_{c}) ELSE least(32, 16 + (abs(err_{c}) - 16) // 2) END)) AS want_{c}''')}
        FROM (
          SELECT *, {each('CAST(floor((ahead_{c} + carried_{c}[x + 1] + 8) / 16.0) AS BIGINT) AS err_{c}')}
          FROM (
            SELECT {fixed}, n, y, CASE WHEN y % 2 = 1 THEN w - 1 - k ELSE k END AS x, CASE WHEN y % 2 = 1 THEN -1 ELSE 1 END AS step,
                   {each('''CASE WHEN k = 0 THEN below_{c}[2:w + 1] ELSE carried_{c} END AS carried_{c},
                   CASE WHEN k = 0 THEN [CAST(0 AS BIGINT) FOR i IN range(0, w + 2)] ELSE below_{c} END AS below_{c},
                   CASE WHEN k = 0 THEN 0 ELSE ahead_{c} END AS ahead_{c}''')}
            FROM (SELECT * EXCLUDE (n, x, y, pen), n + 1 AS n, (n + 1) // w AS y, (n + 1) % w AS k FROM walk WHERE n + 1 < w * h)))))))
SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(pen AS INTEGER) AS pen FROM walk WHERE n >= 0"""


def _boxes_sql(source: str, cells: str, first: str, inside: str, weight: str, colors: int, pens: str) -> str:
    """Median cut as a recursive query: one box of every image is divided per step.

    cells defines the relation tally (image_id, bins): lists of cells, each a list of
    axis values and a count. A box is a struct of lo and size by axis, and hits.
    """
    return f"""WITH RECURSIVE {source.strip()},
{cells.strip()},
cuts AS (
  SELECT image_id, bins, 0 AS step, [{first}] AS boxes FROM tally
  UNION ALL
  SELECT image_id, bins, step + 1,
         boxes[1:spot - 1]
         || CASE WHEN low > 0 THEN [struct_pack(lo := box.lo, size := [CASE WHEN k = axis THEN place + 1 ELSE box.size[k] END FOR k IN range(1, len(box.lo) + 1)], hits := low)] ELSE [] END
         || CASE WHEN box.hits > low THEN [struct_pack(
              lo := [CASE WHEN k = axis THEN box.lo[k] + place + 1 ELSE box.lo[k] END FOR k IN range(1, len(box.lo) + 1)],
              size := [CASE WHEN k = axis THEN box.size[k] - place - 1 ELSE box.size[k] END FOR k IN range(1, len(box.lo) + 1)], hits := box.hits - low)] ELSE [] END
         || boxes[spot + 1:]
  FROM (
    SELECT *, upto[place + 1] AS low
    FROM (
      SELECT *, least(box.size[axis] - 2, list_min([j FOR j IN range(0, box.size[axis]) IF upto[j + 1] >= box.hits // 2])) AS place
      FROM (
        SELECT *, [CAST(coalesce(list_sum([{weight} FOR c IN held IF c[axis] <= box.lo[axis] + j]), 0) AS BIGINT)
                   FOR j IN range(0, box.size[axis])] AS upto
        FROM (
          SELECT *, list_position(box.size, list_max(box.size)) AS axis, [c FOR c IN bins IF {inside}] AS held
          FROM (
            SELECT *, boxes[spot] AS box
            FROM (
              SELECT *, list_max([CASE WHEN list_max(boxes[i].size) > 1 AND boxes[i].hits > 1 THEN boxes[i].hits * 1024 + i ELSE 0 END
                                  FOR i IN range(1, len(boxes) + 1)]) % 1024 AS spot
              FROM cuts WHERE len(boxes) < {colors}) WHERE spot > 0)))))),
ends AS (SELECT image_id, arg_max(bins, step) AS bins, arg_max(boxes, step) AS boxes FROM cuts GROUP BY image_id),
each_box AS (SELECT image_id, bins, i - 1 AS pen, boxes[i] AS box FROM (SELECT *, unnest(range(1, len(boxes) + 1)) AS i FROM ends))
{pens.strip()}"""


def median_cut_sql(source: str, colors: int) -> str:
    inside = " AND ".join(f"c[{k}] >= box.lo[{k}] AND c[{k}] < box.lo[{k}] + box.size[{k}]" for k in (1, 2, 3))
    cells = """
counted AS (SELECT image_id, CAST(r >> 3 AS BIGINT) AS i, CAST(g >> 2 AS BIGINT) AS j, CAST(b >> 3 AS BIGINT) AS k, count(*) AS n
            FROM px GROUP BY ALL),
tally AS (SELECT image_id, list([i, j, k, n]) AS bins FROM counted GROUP BY image_id)"""
    first = "struct_pack(lo := [0::BIGINT, 0, 0], size := [32::BIGINT, 64, 32], hits := CAST(len(bins) AS BIGINT))"
    pens = f"""
SELECT image_id, CAST(pen AS INTEGER) AS pen, CAST((code // 2048) * 8 + (code // 2048) // 4 AS INTEGER) AS r,
       CAST(code // 32 % 64 * 4 + code // 32 % 64 // 16 AS INTEGER) AS g, CAST(code % 32 * 8 + code % 32 // 4 AS INTEGER) AS b
FROM (SELECT image_id, pen, 65535 - list_max([c[4] * 65536 + 65535 - (c[1] * 2048 + c[2] * 32 + c[3])
                                              FOR c IN bins IF {inside}]) % 65536 AS code FROM each_box)"""
    return _boxes_sql(source, cells, first, inside, "1", colors, pens)


def median_cut_gray_sql(source: str, colors: int) -> str:
    inside = "c[1] >= box.lo[1] AND c[1] < box.lo[1] + box.size[1]"
    cells = """
counted AS (SELECT image_id, CAST(r AS BIGINT) AS v, count(*) AS n FROM px GROUP BY ALL),
tally AS (SELECT image_id, list([v, n]) AS bins FROM counted GROUP BY image_id)"""
    first = "struct_pack(lo := [0::BIGINT], size := [256::BIGINT], hits := CAST(list_sum([c[2] FOR c IN bins]) AS BIGINT))"
    pens = f"""
SELECT image_id, CAST(pen AS INTEGER) AS pen, shade AS r, shade AS g, shade AS b
FROM (SELECT image_id, pen, CAST(list_sum([c[1] * c[2] FOR c IN bins IF {inside}])
             // list_sum([c[2] FOR c IN bins IF {inside}]) AS INTEGER) AS shade FROM each_box)"""
    return _boxes_sql(source, cells, first, inside, "c[2]", colors, pens)
