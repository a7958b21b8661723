"""Palettes, nearest pens and dithering.

A palette is a table (image_id, pen, r, g, b) with at most 256 pens per image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..layout import COLORS, SALTS, attach, idiv, packed_rgb, require
from .stats import bin_color, color_histogram_565, gray_histogram

MAX_PENS = 256
PALETTE_SCHEMA = "image_id bigint, pen int, r int, g int, b int"
DIRECT_PENS = 64  # up to here each pixel is matched on its own
ARRAY_BYTES = 16_384  # a palette of 256 pens as an array of structs
COHORT_PIXELS = 1 << 16  # images dithered side by side in one task hold about as many


def _check_pens(colors: int) -> None:
    require(1 <= colors <= MAX_PENS, "a palette has 1..256 pens")


def palette_popularity(df: DataFrame, colors: int) -> DataFrame:
    """The fullest 5-6-5 bins, ties by bin. The rank window has <= 65536 rows."""
    _check_pens(colors)
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "bin")
    top = (
        color_histogram_565(df)
        .withColumn("pen", F.row_number().over(order) - 1)
        .where(F.col("pen") < colors)
    )
    shades = bin_color(F.col("bin"))
    return top.select("image_id", "pen", *[shades[c].alias(c) for c in COLORS])


def palette_popularity_gray(df: DataFrame, colors: int) -> DataFrame:
    """The fullest gray levels, ties by level."""
    _check_pens(colors)
    order = Window.partitionBy("image_id").orderBy(F.desc("n"), "value")
    top = (
        gray_histogram(df)
        .withColumn("pen", F.row_number().over(order) - 1)
        .where(F.col("pen") < colors)
    )
    return top.select("image_id", "pen", *[F.col("value").alias(c) for c in COLORS])


class _Box:
    """A box of histogram cells: lower corner, extent and its hits."""

    def __init__(self, lo: list[int], size: list[int], hits: int):
        self.lo, self.size, self.hits = lo, size, hits

    def cells(self, cube: np.ndarray) -> np.ndarray:
        return cube[tuple(slice(a, a + n) for a, n in zip(self.lo, self.size))]

    def divide(self, weights: np.ndarray) -> _Box:
        """Cut the longest axis at half the weight; keep the lower part, return the rest."""
        axis = int(np.argmax(self.size))
        others = tuple(i for i in range(weights.ndim) if i != axis)
        upto = np.cumsum(self.cells(weights).sum(axis=others))
        total = int(upto[-1])
        at = min(int(np.searchsorted(upto, total >> 1)), self.size[axis] - 2)
        lo, size = list(self.lo), list(self.size)
        lo[axis] += at + 1
        size[axis] -= at + 1
        self.size[axis] = at + 1
        self.hits = int(upto[at])
        return _Box(lo, size, total - self.hits)


def cut_boxes(weights: np.ndarray, colors: int) -> list[_Box]:
    """Median cut: the occupied box with most hits (the last of equals) is divided until
    there are as many as colours or nothing is left to divide; empty parts are dropped."""
    boxes = [_Box([0] * weights.ndim, list(weights.shape), int(weights.sum()))]
    while len(boxes) < colors:
        hits, at = max(((b.hits, i) for i, b in enumerate(boxes) if max(b.size) > 1), default=(0, 0))
        if hits <= 1:
            break
        rest = boxes[at].divide(weights)
        boxes[at : at + 1] = [b for b in (boxes[at], rest) if b.hits]
    return boxes


def _median_cut_image(hist: pd.DataFrame, colors: int) -> pd.DataFrame:
    cube = np.zeros(65536, dtype=np.int64)
    cube[hist["bin"].to_numpy()] = hist["n"].to_numpy()
    cube = cube.reshape(32, 64, 32)
    pens = []
    for box in cut_boxes((cube > 0).astype(np.int64), colors):
        cells = box.cells(cube)
        best = np.unravel_index(int(np.argmax(cells)), cells.shape)
        r, g, b = (int(o + i) for o, i in zip(box.lo, best))
        pens.append((r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2))
    out = pd.DataFrame(pens, columns=list(COLORS), dtype="int32")
    out.insert(0, "pen", np.arange(len(out), dtype="int32"))
    out.insert(0, "image_id", hist["image_id"].iloc[0])
    return out


def palette_median_cut(df: DataFrame, colors: int) -> DataFrame:
    """Median cut over occupied 5-6-5 bins; the fullest bin of each box is its pen.

    Spark aggregates the pixels; the grouped function sees at most 65536
    histogram rows per image, whatever the image size.
    """
    _check_pens(colors)

    def cut(hist: pd.DataFrame) -> pd.DataFrame:
        return _median_cut_image(hist, colors)

    return color_histogram_565(df).groupBy("image_id").applyInPandas(cut, PALETTE_SCHEMA)


def _median_cut_levels(hist: pd.DataFrame, colors: int) -> pd.DataFrame:
    levels = np.zeros(256, dtype=np.int64)
    levels[hist["value"].to_numpy()] = hist["n"].to_numpy()
    pens = []
    for box in cut_boxes(levels, colors):
        cells = box.cells(levels)
        at = np.arange(box.lo[0], box.lo[0] + box.size[0])
        pens.append(int((cells * at).sum()) // int(cells.sum()))
    shade = np.array(pens, dtype="int32")
    return pd.DataFrame(
        {
            "image_id": hist["image_id"].iloc[0],
            "pen": np.arange(len(pens), dtype="int32"),
            "r": shade,
            "g": shade,
            "b": shade,
        }
    )


def palette_median_cut_gray(df: DataFrame, colors: int) -> DataFrame:
    """1-D median cut weighted by pixel counts; a pen is its box's mean level."""
    _check_pens(colors)

    def cut(hist: pd.DataFrame) -> pd.DataFrame:
        return _median_cut_levels(hist, colors)

    return gray_histogram(df).groupBy("image_id").applyInPandas(cut, PALETTE_SCHEMA)


def palette_force(images: DataFrame, palettes: DataFrame) -> DataFrame:
    """Give each image (image_id, palette_id) the pens of a stored palette.

    A palette is gathered into one row first; a palette used by most images is
    dealt over slots.
    """
    stored = palettes.groupBy("palette_id").agg(
        F.sort_array(F.collect_list(F.struct("pen", *COLORS))).alias("pal")
    )
    joined = attach(images, stored, slot=F.xxhash64("image_id"), key="palette_id")
    return joined.select("image_id", F.inline("pal"))


def palette_halfbright(palettes: DataFrame) -> DataFrame:
    """Append every pen again at half brightness, numbered after the originals."""
    pens = Window.partitionBy("image_id")
    counted = palettes.withColumn("_n", F.max("pen").over(pens) + 1)
    halves = counted.select(
        "image_id",
        (F.col("pen") + F.col("_n")).alias("pen"),
        *[F.shiftright(c, 1).alias(c) for c in COLORS],
    )
    return palettes.select("image_id", "pen", *COLORS).unionByName(halves)


def palette_arrays(palettes: DataFrame) -> DataFrame:
    """One row per image: ``pal``, its pens in order (at most 256)."""
    return palettes.groupBy("image_id").agg(
        F.sort_array(F.collect_list(F.struct("pen", *COLORS))).alias("pal")
    )


def palette_bytes(palettes: DataFrame) -> DataFrame:
    """One row per image: ``pal``, three bytes per pen, and ``_pens``, their numbers."""
    code = lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in COLORS])
    text = F.array_join(F.transform("pal", code), "")
    return palette_arrays(palettes).select(
        "image_id", F.unhex(text).alias("pal"), F.col("pal.pen").alias("_pens")
    )


def nearest_pens(rgb: np.ndarray, choice: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Nearest pen of each colour in its palette (tables[choice]); the first wins ties."""
    out = np.empty(len(rgb), dtype=np.int32)
    step = max(1, 1_000_000 // tables.shape[1])
    for i in range(0, len(rgb), step):
        gap = rgb[i : i + step, None, :] - tables[choice[i : i + step]]
        out[i : i + step] = np.einsum("npc,npc->np", gap, gap).argmin(axis=1)
    return out


def _nearest_pen():
    """Column: number of the pen nearest to (r, g, b), in Arrow batches; NULL without palette."""

    @F.arrow_udf("int")
    def match(r: pa.Array, g: pa.Array, b: pa.Array, pal: pa.Array) -> pa.Array:
        coded = pc.fill_null(pal, bytes(3)).dictionary_encode()
        found = [
            np.frombuffer(p, dtype=np.uint8).reshape(-1, 3) for p in coded.dictionary.to_pylist()
        ]
        if not found:
            return pa.array([], pa.int32())
        most = max(map(len, found))
        # a shorter palette repeats its last pen, which never wins over the original
        tables = np.stack([np.pad(p, ((0, most - len(p)), (0, 0)), mode="edge") for p in found])
        rgb = np.stack([c.to_numpy(zero_copy_only=False) for c in (r, g, b)], axis=1)
        choice = coded.indices.to_numpy()
        return pa.array(nearest_pens(rgb.astype(np.int32), choice, tables.astype(np.int32)))

    return F.get("_pens", match("r", "g", "b", "pal"))


def map_to_palette(
    df: DataFrame, palettes: DataFrame, pens: int = MAX_PENS, rows: int | None = None
) -> DataFrame:
    """Add ``pen``: the number of the palette entry nearest in squared RGB distance.

    An image without a palette keeps its pixels, with a NULL pen.

    The palette travels as a few bytes, so matching is a projection and no pairs
    of rows are formed. With many pens the distinct colours are matched first
    and joined back; that join is dealt over slots, because one background
    colour may fill most of an image.
    """
    arrays = palette_bytes(palettes)
    if pens <= DIRECT_PENS:
        return attach(df, arrays, "left", rows=rows).withColumn("pen", _nearest_pen()).drop("pal", "_pens")
    shades = df.select("image_id", *COLORS, F.pmod("y", F.lit(SALTS)).cast("int").alias("_slot"))
    distinct = shades.groupBy("image_id", *COLORS).agg(F.collect_set("_slot").alias("_slots"))
    matched = (
        attach(distinct, arrays, "left", rows=rows, slot=packed_rgb())
        .select("image_id", packed_rgb().alias("_rgb"), "_slots", _nearest_pen().alias("pen"))
        .select("image_id", "_rgb", "pen", F.explode("_slots").alias("_slot"))
    )
    keyed = df.withColumns(
        {"_rgb": packed_rgb(), "_slot": F.pmod("y", F.lit(SALTS)).cast("int")}
    )
    return keyed.join(matched, ["image_id", "_rgb", "_slot"]).select(*df.columns, "pen")


def map_gray_to_palette(
    df: DataFrame, palettes: DataFrame, rows: int | None = None
) -> DataFrame:
    """Nearest pen by gray level: a 256-entry table per image, then a lookup."""
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(255)),
        lambda v: F.array_min(
            F.transform("pal", lambda p: F.abs(p["r"] - v) * 1024 + p["pen"])
        )
        .bitwiseAND(F.lit(1023))
        .cast("int"),
    )
    tables = palette_arrays(palettes).select("image_id", levels.alias("_pens"))
    return (
        attach(df, tables, "left", rows=rows)
        .withColumn("pen", F.get("_pens", F.col("r")))
        .drop("_pens")
    )


def error_limit(error: np.ndarray) -> np.ndarray:
    """Damp diffused errors: 1:1 to 16, 1:2 to 48, then constant 32."""
    size = np.abs(error)
    damped = np.where(size < 16, size, np.minimum(32, 16 + (size - 16) // 2))
    return np.sign(error) * damped


def _diffuse_line(
    line: np.ndarray, carried: np.ndarray, pens: np.ndarray, backward: bool, opaque: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Dither one scan line of several images at once.

    line: images x width x channels; carried: errors from the line above, in
    sixteenths; pens: images x pens x channels; opaque: images x width, by how much
    of 256 a colour shows over black when its pen is chosen. Returns positions of pens
    and the errors for the line below.
    """
    images, width, channels = line.shape
    below = np.zeros((images, width + 2, channels), dtype=np.int64)
    chosen = np.empty((images, width), dtype=np.int32)
    ahead = np.zeros((images, channels), dtype=np.int64)
    every = np.arange(images)
    step = -1 if backward else 1
    for x in range(width - 1, -1, -1) if backward else range(width):
        error = error_limit((ahead + carried[:, x] + 8) >> 4)
        wanted = np.clip(line[:, x] + error, 0, 255)
        gap = (wanted * opaque[:, x, None] >> 8)[:, None, :] - pens
        pen = np.argmin((gap * gap).sum(axis=2), axis=1)
        chosen[:, x] = pen
        left = wanted - pens[every, pen]
        ahead = left * 7
        at = x + 1
        below[:, at - step] += left * 3
        below[:, at] += left * 5
        below[:, at + step] += left
    return chosen, below[:, 1:-1]


def _diffuse_lines(batches: Iterator[pd.DataFrame], channels: str) -> Iterator[pd.DataFrame]:
    """Lines arrive sorted by (cohort, y, image); state is one error line per image."""
    cohort, errors = None, {}
    pending: list = []

    def flush() -> Iterator[pd.DataFrame]:
        groups: dict = {}
        for row in pending:
            if row.pal_r is None:  # no palette: the line stays, without pens
                groups.setdefault((len(row.r), 0), []).append(row)
            else:
                groups.setdefault((len(row.r), len(row.pal_r)), []).append(row)
        for (width, size), rows in groups.items():
            if not size:
                yield lines_of(rows, [[None] * width for _ in rows])
                continue
            stack = lambda prefix: np.stack(
                [
                    np.stack([np.asarray(getattr(r, prefix + c), dtype=np.int64) for c in channels], 1)
                    for r in rows
                ]
            )
            line, pens = stack(""), stack("pal_")
            blank = np.zeros((width, len(channels)), dtype=np.int64)
            carried = np.stack([errors.get(r.image_id, blank) for r in rows])
            opaque = np.stack([np.asarray(r.opaque, dtype=np.int64) for r in rows])
            chosen, below = _diffuse_line(line, carried, pens, rows[0].y % 2 == 1, opaque)
            for row, left in zip(rows, below):
                errors[row.image_id] = left
            numbers = np.stack([np.asarray(r.pal_pen, dtype=np.int32) for r in rows])
            yield lines_of(rows, list(np.take_along_axis(numbers, chosen, axis=1)))

    def lines_of(rows: list, pens: list) -> pd.DataFrame:
        fixed = {c: [getattr(r, c) for r in rows] for c in ("image_id", "width", "height", "y")}
        return pd.DataFrame({**fixed, "pens": pens})

    for batch in batches:
        for row in batch.itertuples(index=False):
            if pending and (row.cohort, row.y) != (pending[0].cohort, pending[0].y):
                yield from flush()
                pending = []
            if row.cohort != cohort:
                cohort, errors = row.cohort, {}
            pending.append(row)
    if pending:
        yield from flush()


def _error_diffusion(
    df: DataFrame, palettes: DataFrame, channels: str, rows: int | None, alpha: bool = False
) -> DataFrame:
    """Serpentine error diffusion; parallel over images, serial inside one.

    Each pixel depends on all earlier ones, so an image cannot be divided.
    Tasks stream scan lines in order and keep one line of errors per image. Small
    images go side by side in cohorts of about COHORT_PIXELS, a large one alone:
    memory does not grow with the image height, nor does a task hold many large ones.
    """
    power = F.ceil(F.log2(F.col("width").cast("bigint") * F.col("height"))).cast("int")
    together = F.greatest(F.lit(1), F.call_function("shiftright", F.lit(COHORT_PIXELS), F.least(F.lit(30), power)))
    cohort = F.xxhash64(power, idiv(F.col("image_id"), together))
    opaque = 255 - F.col("a") if alpha else F.lit(None).cast("int")
    cell = F.struct("x", *channels, F.coalesce(opaque, F.lit(256)).alias("opaque"))
    lines = df.groupBy("image_id", "width", "height", "y").agg(
        F.sort_array(F.collect_list(cell)).alias("cells")
    )
    keyed = attach(lines, palette_arrays(palettes), "left", rows=rows, row_bytes=ARRAY_BYTES).select(
        cohort.alias("cohort"),
        "image_id",
        "width",
        "height",
        "y",
        *[F.col(f"cells.{c}").alias(c) for c in (*channels, "opaque")],
        *[F.col(f"pal.{c}").alias(f"pal_{c}") for c in channels],
        F.col("pal.pen").alias("pal_pen"),
    )
    ordered = keyed.repartition("cohort").sortWithinPartitions("cohort", "y", "image_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _diffuse_lines(batches, channels)

    out = ordered.mapInPandas(
        run, "image_id bigint, width int, height int, y int, pens array<int>"
    )
    return out.select("image_id", "width", "height", "y", F.posexplode("pens").alias("x", "pen"))


def dither_floyd_steinberg(
    df: DataFrame, palettes: DataFrame, rows: int | None = None, alpha: bool = False
) -> DataFrame:
    """(image_id, width, height, y, x, pen) by 7/3/5/1 error diffusion.

    With ``alpha`` a pen is chosen for the colour as it shows over black.
    """
    return _error_diffusion(df, palettes, "rgb", rows, alpha)


def dither_floyd_steinberg_gray(
    df: DataFrame, palettes: DataFrame, rows: int | None = None
) -> DataFrame:
    """The same on the one channel of gray rasters."""
    return _error_diffusion(df, palettes, "r", rows)


def expand_indexed(indexed: DataFrame, palettes: DataFrame, rows: int | None = None) -> DataFrame:
    """Pens back to colours, through the palette array of each image.

    A pen that its palette lacks has NULL colours.
    """
    joined = attach(indexed, palette_arrays(palettes), "left", rows=rows, row_bytes=ARRAY_BYTES)
    straight = F.get("pal", F.col("pen"))  # the usual case: pens 0, 1, 2, ...
    entry = F.when(straight["pen"] == F.col("pen"), straight).otherwise(
        F.get(F.filter("pal", lambda p: p["pen"] == F.col("pen")), F.lit(0))
    )
    return joined.withColumns({c: entry[c] for c in COLORS}).drop("pal")


def palette_black_white(palettes: DataFrame) -> DataFrame:
    """Pen 0 black and pen 1 white: the nearest pens change places with them first.

    White is placed before black; pens are numbered 0, 1, 2, ... anew. A palette of
    one pen gets black only.
    """
    gap = lambda p, v: sum((p[c] - v) * (p[c] - v) for c in COLORS)

    def swapped(pal: Column, to: int, shade: int) -> Column:
        ranks = F.transform(pal, lambda p, i: gap(p, shade).cast("bigint") * 1024 + i)
        best = F.array_min(ranks) % 1024
        forced = F.struct(F.lit(to).alias("pen"), *[F.lit(shade).alias(c) for c in COLORS])

        def entry(p: Column, i: Column) -> Column:
            other = F.when(i == best, F.get(pal, F.lit(to))).otherwise(p)
            return F.when(i == to, forced).otherwise(
                F.struct(i.cast("int").alias("pen"), *[other[c].alias(c) for c in COLORS])
            )

        return F.when(F.size(pal) > to, F.transform(pal, entry)).otherwise(pal)

    arrays = palette_arrays(palettes).withColumn("pal", swapped(F.col("pal"), 1, 255))
    return arrays.withColumn("pal", swapped(F.col("pal"), 0, 0)).select("image_id", F.inline("pal"))


def blend_over_black(df: DataFrame) -> DataFrame:
    """Colours as they show over black: c * (255 - a) >> 8 where there is alpha."""
    opaque = F.coalesce(255 - F.col("a"), F.lit(256))
    return df.withColumns({c: F.shiftright(F.col(c) * opaque, 8) for c in COLORS})


PALETTE_METHODS = {"popularity": palette_popularity, "median_cut": palette_median_cut}
GRAY_METHODS = {"popularity": palette_popularity_gray, "median_cut": palette_median_cut_gray}


def render_indexed(
    df: DataFrame,
    colors: int = 16,
    dither: str = "none",
    palette: str | DataFrame = "popularity",
    rows: int | None = None,
    gray: bool = False,
    alpha: bool = False,
    halfbright: bool = False,
    force_bw: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Quantise rasters: returns (pens per pixel, palettes).

    dither: none, ordered or floyd; palette: popularity, median_cut or a table.
    gray: rasters of one channel, with gray palettes and lookups. alpha: pens are
    chosen for the colours as they show over black. halfbright: every pen again at
    half brightness. force_bw: pen 0 black, pen 1 white.
    """
    require(dither in ("none", "ordered", "floyd"), f"unknown dither {dither}")
    require(not (gray and alpha), "gray rasters have no alpha")
    if isinstance(palette, DataFrame):
        palettes = palette
    else:
        methods = GRAY_METHODS if gray else PALETTE_METHODS
        require(palette in methods, f"unknown palette method {palette}")
        palettes = methods[palette](df, colors)
    if force_bw:
        palettes = palette_black_white(palettes)
    if halfbright:
        palettes, colors = palette_halfbright(palettes), 2 * colors
    if dither == "floyd" and gray:
        indexed = dither_floyd_steinberg_gray(df, palettes, rows)
    elif dither == "floyd":
        indexed = dither_floyd_steinberg(df, palettes, rows, alpha)
    else:
        from ..functions.ordered import ordered_dither

        lifted = ordered_dither(df) if dither == "ordered" else df
        lifted = blend_over_black(lifted) if alpha else lifted
        if gray:
            indexed = map_gray_to_palette(lifted, palettes, rows)
        else:
            indexed = map_to_palette(lifted, palettes, colors, rows)
    return indexed.select("image_id", "y", "x", "pen"), palettes
