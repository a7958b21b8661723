"""Convolutions, blur, median, local equalisation, isolated pixels."""

from __future__ import annotations

from ..functions import tone
from ..functions.kernels import LIBRARY, PRESETS, Kernel, preset
from ..operators import stencil
from .core import (
    ARGB_SQL, GRAY_SQL, RGB_SQL, argb, gray, query, rgb, shown, sql_then, wide_rgb,
)
from .geometry import LINES_CUT_SQL
from .points import BOX_SQL, box


def kernel_sql(kernels: list[Kernel]) -> str:
    rows = [
        f"('{k.name}', {k.bias}, {k.divisor}, {dy}, {dx}, {w})"
        for k in kernels for dy, dx, w in k.taps()]
    return f"kernels(kernel, bias, divisor, dy, dx, w) AS (VALUES {', '.join(rows)})"


def convolve_sql(source: str, kernels: list[Kernel], keep: str = "", extra: str = "") -> str:
    sums = ", ".join(f"sum(q.{c} * w) // any_value(divisor) + any_value(bias) AS {c}" for c in "rgb")
    return sql_then(source, kernel_sql(kernels) + f""",
summed AS (
  SELECT kernel, p.image_id, p.y, p.x, {sums}
  FROM px p CROSS JOIN kernels k
  LEFT JOIN px q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx
  GROUP BY kernel, p.image_id, p.y, p.x)""", f"""
SELECT {keep}s.image_id, s.y, s.x, {extra}""" + ", ".join(
        f"CAST(least(255, greatest(0, coalesce(s.{c}, 0))) AS INTEGER) AS {c}" for c in "rgb")
        + " FROM summed s JOIN px p ON p.image_id = s.image_id AND p.y = s.y AND p.x = s.x")


@query("convolve", convolve_sql(ARGB_SQL, [preset("gauss8")], extra="p.a, "))
def _(spark, d):
    return shown(stencil.convolve(argb(spark, d), preset("gauss8")), "a")


@query("convolve_region", sql_then(RGB_SQL, f"""
inner_result AS ({convolve_sql(RGB_SQL, [preset('laplace8')])})""", f"""
SELECT p.image_id, p.y, p.x, CASE WHEN {BOX_SQL.replace('x ', 'p.x ').replace('y ', 'p.y ')} THEN i.r ELSE p.r END AS r,
       CASE WHEN {BOX_SQL.replace('x ', 'p.x ').replace('y ', 'p.y ')} THEN i.g ELSE p.g END AS g,
       CASE WHEN {BOX_SQL.replace('x ', 'p.x ').replace('y ', 'p.y ')} THEN i.b ELSE p.b END AS b
FROM px p JOIN inner_result i ON i.image_id = p.image_id AND i.y = p.y AND i.x = p.x"""))
def _(spark, d):
    return shown(stencil.convolve(rgb(spark, d), preset("laplace8"), box()))


PRESET_KERNELS = [Kernel.of(*e) for e in PRESETS]
LIBRARY_KERNELS = [Kernel.of(*e) for e in LIBRARY]


@query("convolve_presets", convolve_sql(RGB_SQL, PRESET_KERNELS, keep="kernel, "))
def _(spark, d):
    out = stencil.convolve_each(wide_rgb(spark, d), PRESET_KERNELS)
    return out.select("kernel", "image_id", "y", "x", "r", "g", "b")


@query("convolve_library", convolve_sql(RGB_SQL, LIBRARY_KERNELS, keep="kernel, "))
def _(spark, d):
    out = stencil.convolve_each(wide_rgb(spark, d), LIBRARY_KERNELS)
    return out.select("kernel", "image_id", "y", "x", "r", "g", "b")


@query("box_blur_separable", convolve_sql(GRAY_SQL, [preset("average7")]))
def _(spark, d):
    return shown(stencil.box_blur_separable(gray(spark, d), 3))


def median_sql(source: str, radius: int) -> str:
    side = f"range(-{radius}, {radius + 1})"
    mid = ", ".join(
        f"CAST(quantile_disc(q.{c}, 0.5) AS INTEGER) AS {c}" for c in "rgb")
    return sql_then(source, f"""
taps AS (SELECT i AS dy, j AS dx FROM (SELECT unnest({side}) AS i) CROSS JOIN (SELECT unnest({side}) AS j))""", f"""
SELECT p.image_id, p.y, p.x, {mid}
FROM px p CROSS JOIN taps t
JOIN px q ON q.image_id = p.image_id AND q.y = least(p.height - 1, greatest(0, p.y + dy))
     AND q.x = least(p.width - 1, greatest(0, p.x + dx))
GROUP BY p.image_id, p.y, p.x""")


@query("median", median_sql(RGB_SQL, 1))
def _(spark, d):
    return shown(stencil.median(rgb(spark, d), 1))


@query("median_wide", median_sql(RGB_SQL, 3))
def _(spark, d):
    return shown(stencil.median(rgb(spark, d), 3))


@query("hist_eq_local", sql_then(GRAY_SQL, """
taps AS (SELECT i AS dy, j AS dx FROM (SELECT unnest(range(-4, 5)) AS i) CROSS JOIN (SELECT unnest(range(-4, 5)) AS j))""", """
SELECT p.image_id, p.y, p.x, CAST(255 * count(*) FILTER (q.r <= p.r) // count(*) AS INTEGER) AS r,
       CAST(255 * count(*) FILTER (q.g <= p.g) // count(*) AS INTEGER) AS g,
       CAST(255 * count(*) FILTER (q.b <= p.b) // count(*) AS INTEGER) AS b
FROM px p CROSS JOIN taps t
JOIN px q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx
GROUP BY p.image_id, p.y, p.x"""))
def _(spark, d):
    return shown(stencil.hist_eq_local(gray(spark, d), 4))


@query("remove_isolated", sql_then(GRAY_SQL, LINES_CUT_SQL + """,
coded AS (SELECT image_id, y, x, r * 65536 + g * 256 + b AS v FROM cut),
sides AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS e FROM coded WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
threes AS (
  SELECT *, CASE WHEN l IS NULL OR e IS NULL THEN NULL ELSE least(l, v, e) END AS least3,
         CASE WHEN l IS NULL OR e IS NULL THEN NULL ELSE greatest(l, v, e) END AS most3 FROM sides),
around AS (
  SELECT image_id, y, x, l, e, lag(least3) OVER w AS lo_up, lag(most3) OVER w AS hi_up,
         lead(least3) OVER w AS lo_down, lead(most3) OVER w AS hi_down
  FROM threes WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
judged AS (
  SELECT image_id, y, x,
         CASE WHEN l IS NULL OR e IS NULL OR lo_up IS NULL OR lo_down IS NULL THEN 0 ELSE 8 END AS n,
         least(l, e, lo_up, lo_down) AS lo, greatest(l, e, hi_up, hi_down) AS hi FROM around)""", """
SELECT p.image_id, p.y, p.x, CAST(CASE WHEN n = 8 AND lo = hi THEN lo // 65536 ELSE r END AS INTEGER) AS r,
       CAST(CASE WHEN n = 8 AND lo = hi THEN lo // 256 % 256 ELSE g END AS INTEGER) AS g,
       CAST(CASE WHEN n = 8 AND lo = hi THEN lo % 256 ELSE b END AS INTEGER) AS b
FROM cut p JOIN judged a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x"""))
def _(spark, d):
    return shown(stencil.remove_isolated(tone.threshold_channel(gray(spark, d), 200)))
