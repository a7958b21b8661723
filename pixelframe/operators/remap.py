"""Several canvas steps as one coordinate map.

Crop, roll, whole flips, shift, enlarged canvases and quick scaling move lines and
columns independently and fill vacated cells with a constant. A run of such steps is one
map an axis: pixels go through all of them in projections, and the cells that end
without a source are made once, from the first pixel of each image, by walking back from
the last step to the first that left them empty. So a run reads its source twice,
however many steps it has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import CHANNELS, MAX_SIDE, PIXEL_COLUMNS, as_pixels, heads, idiv, require, span
from .geometry import covered


@dataclass(frozen=True)
class Axis:
    """One step along one axis, in terms of a position and the size before it.

    size: the size after the step; ahead: where a position goes (outside: dropped);
    copies: the positions it goes to, for steps that repeat or skip. Backwards, a position
    comes from at * num div den + off, modulo the size if it wraps (outside: filled).
    """

    size: Callable[[Column], Column] = lambda n: n
    ahead: Callable[[Column, Column], Column] = lambda at, n: at
    copies: Callable[[Column, Column], Column] | None = None
    num: Callable[[Column], Column] = lambda n: F.lit(1)
    den: int = 1
    off: Callable[[Column], Column] = lambda n: F.lit(0)
    wraps: bool = False

    def backwards(self, number: int, n: Column) -> Column:
        fields = {"number": F.lit(number), "n": n, "num": self.num(n), "den": F.lit(self.den), "off": self.off(n)}
        return F.struct(*[c.cast("bigint").alias(k) for k, c in fields.items()], F.lit(self.wraps).alias("wraps"))


def _crop(lo: int, hi: int) -> Axis:
    return Axis(lambda n: F.least(F.lit(hi), n) - lo, lambda at, n: at - lo, off=lambda n: F.lit(lo))


def _roll(d: int) -> Axis:
    return Axis(ahead=lambda at, n: F.pmod(at + d, n), off=lambda n: F.lit(-d), wraps=True)


def _flip() -> Axis:
    return Axis(ahead=lambda at, n: n - 1 - at, num=lambda n: F.lit(-1), off=lambda n: n - 1)


def _shift(d: int) -> Axis:
    return Axis(ahead=lambda at, n: at + d, off=lambda n: F.lit(-d))


def _canvas(new: int) -> Axis:
    def before(n: Column) -> Column:
        return idiv(F.greatest(F.lit(new), n) - n, 2).cast("int")

    return Axis(lambda n: F.greatest(F.lit(new), n), lambda at, n: at + before(n), off=lambda n: -before(n))


def _scale(new: int) -> Axis:
    return Axis(lambda n: F.lit(new), copies=lambda at, n: covered(at, n, F.lit(new)), num=lambda n: n, den=new)


@dataclass(frozen=True)
class Step:
    x: Axis
    y: Axis
    fill: int | None = None  # value of vacated cells, None if there are none


def step(name: str, arguments: Mapping[str, Any]) -> Step | None:
    """The map of a named step, or None if it has none of this kind."""
    name, given = name.upper(), dict(arguments)
    if name == "CROP" and set(given) == {"x0", "y0", "x1", "y1"}:
        x0, y0, x1, y1 = (given[k] for k in ("x0", "y0", "x1", "y1"))
        require(0 <= x0 < x1 and 0 <= y0 < y1, "the box is not empty")
        return Step(_crop(x0, x1), _crop(y0, y1))
    if name in ("ROLL", "SHIFT") and set(given) <= {"dx", "dy"}:
        dx, dy = given.get("dx", 0), given.get("dy", 0)
        return Step(_roll(dx), _roll(dy)) if name == "ROLL" else Step(_shift(dx), _shift(dy), 0)
    if name == "FLIPX" and not given:
        return Step(_flip(), Axis())
    if name == "FLIPY" and not given:
        return Step(Axis(), _flip())
    sizes = [given.get("width", given.get("new_width")), given.get("height", given.get("new_height"))]
    if not all(isinstance(n, int) for n in sizes):
        return None
    if name == "RESIZE" and set(given) <= {"width", "height", "fill"} and given.get("fill", "black") in ("black", "white"):
        require(all(1 <= n <= MAX_SIDE for n in sizes), "size out of range")
        return Step(_canvas(sizes[0]), _canvas(sizes[1]), 0 if given.get("fill", "black") == "black" else 255)
    if name == "SCALE" and set(given) == {"new_width", "new_height"} and min(sizes) >= 1:
        return Step(_scale(sizes[0]), _scale(sizes[1]))
    return None


def _moved(df: DataFrame, move: Step) -> DataFrame:
    """The pixels after one step, without its vacated cells."""
    for at, size, axis in (("x", "width", move.x), ("y", "height", move.y)):
        where = F.explode(axis.copies(F.col(at), F.col(size))) if axis.copies else axis.ahead(F.col(at), F.col(size))
        df = df.withColumn("_at", where).withColumn("_size", axis.size(F.col(size)))
        df = df.where((F.col("_at") >= 0) & (F.col("_at") < F.col("_size")))
        df = df.withColumns({at: F.col("_at"), size: F.col("_size")}).drop("_at", "_size")
    return df


def _emptied(at: str, size: str, axes: list[Axis]) -> Column:
    """The number of the last step that left a position empty, 0 if none did.

    The steps are data, walked by one expression: nested expressions would double with each step.
    """
    steps = F.array(*[axes[k - 1].backwards(k, F.col(f"{size}{k - 1}")) for k in range(len(axes), 0, -1)])

    def walk(held: Column, step: Column) -> Column:
        place = F.call_function("div", held["at"] * step["num"], step["den"]) + step["off"]
        place = F.when(step["wraps"], F.pmod(place, step["n"])).otherwise(place)
        return F.struct(place.alias("at"), F.when(held["empty"] > 0, held["empty"]).otherwise(held["next"]).alias("empty"),
                        F.when((place < 0) | (place >= step["n"]), step["number"]).otherwise(F.lit(0).cast("bigint")).alias("next"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(F.col(at).cast("bigint").alias("at"), zero.alias("empty"), zero.alias("next"))
    return F.aggregate(steps, start, walk, lambda held: F.when(held["empty"] > 0, held["empty"]).otherwise(held["next"]).cast("int"))


def folded(df: DataFrame, steps: list[Step]) -> DataFrame:
    """All steps in one map; the same pixels as one after the other."""
    found = df
    for move in steps:
        found = _moved(found, move)
    found = as_pixels(found.select(*PIXEL_COLUMNS))
    if all(s.fill is None for s in steps):
        return found
    first = heads(df).select("image_id", "a", F.col("width").alias("width0"), F.col("height").alias("height0"))
    exists = F.lit(True)
    for number, move in enumerate(steps, 1):
        now = {f"width{number}": move.x.size(F.col(f"width{number - 1}")), f"height{number}": move.y.size(F.col(f"height{number - 1}"))}
        first = first.withColumns(now)
        exists &= (F.col(f"width{number}") > 0) & (F.col(f"height{number}") > 0)
    last = len(steps)
    lines = first.where(exists).withColumn("y", F.explode(span(F.lit(0), F.col(f"height{last}")))).repartition("image_id", "y")
    lines = lines.withColumn("_y", _emptied("y", "height", [s.y for s in steps]))
    cells = lines.withColumn("x", F.explode(span(F.lit(0), F.col(f"width{last}"))))
    cells = cells.withColumn("_step", F.greatest("_y", _emptied("x", "width", [s.x for s in steps]))).where("_step > 0")
    # a crop drops cells that are outside before it; only steps with a fill leave some empty
    value = F.element_at(F.array(*[F.lit(s.fill or 0) for s in steps]), F.col("_step"))
    paint = {c: value for c in CHANNELS} | {"a": F.when(F.col("a").isNotNull(), value)}
    paint |= {"width": F.col(f"width{last}"), "height": F.col(f"height{last}")}
    return found.unionByName(as_pixels(cells.select(*[paint.get(c, F.col(c)).alias(c) for c in PIXEL_COLUMNS])))
