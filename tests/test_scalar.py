"""Grouped kernels against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import quantize, stats, stencil
from pixelframe.sources import tables


def picture(seed, height, width):
    rng = random.Random(seed)
    return [[tuple(rng.randrange(256) for _ in range(3)) for _ in range(width)] for _ in range(height)]


def limited(e):
    size = abs(e)
    out = size if size < 16 else 16 + (size - 16) // 2 if size < 48 else 32
    return out if e >= 0 else -out


def diffused(rows, pens):
    """Serpentine diffusion, one pixel and one channel at a time."""
    height, width, channels = len(rows), len(rows[0]), len(rows[0][0])
    spread = {}
    out = {}
    for y in range(height):
        xs = range(width - 1, -1, -1) if y % 2 else range(width)
        step = -1 if y % 2 else 1
        for x in xs:
            want = []
            for c in range(channels):
                error = limited((spread.get((y, x, c), 0) + 8) >> 4)
                want.append(min(255, max(0, rows[y][x][c] + error)))
            gaps = [sum((w - p) ** 2 for w, p in zip(want, pen)) for pen in pens]
            out[y, x] = gaps.index(min(gaps))
            for c in range(channels):
                left = want[c] - pens[out[y, x]][c]
                for dy, dx, k in ((0, step, 7), (1, -step, 3), (1, 0, 5), (1, step, 1)):
                    at = (y + dy, x + dx, c)
                    spread[at] = spread.get(at, 0) + k * left
    return out


def pens_of(df):
    return {(r["image_id"], r["y"], r["x"]): r["pen"] for r in df.collect()}


def test_floyd_steinberg(spark, raster):
    shapes = {3: (9, 14), 4: (6, 5), 70: (1, 1), 71: (9, 14)}
    pens = [(0, 0, 0), (255, 255, 255), (200, 30, 40), (30, 90, 220), (90, 200, 90)]
    pictures = {i: picture(i, *s) for i, s in shapes.items()}
    df = None
    for i, rows in pictures.items():
        df = raster(rows, i) if df is None else df.unionByName(raster(rows, i))
    table = [(i, n, *p) for i in shapes for n, p in enumerate(pens)]
    palette = spark.createDataFrame(table, quantize.PALETTE_SCHEMA)
    got = pens_of(quantize.dither_floyd_steinberg(df, palette))
    want = {(i, y, x): p for i, rows in pictures.items() for (y, x), p in diffused(rows, pens).items()}
    assert got == want


def test_floyd_steinberg_gray(spark, raster):
    rows = [[c[0] for c in line] for line in picture(5, 8, 11)]
    levels = [0, 90, 170, 255]
    palette = spark.createDataFrame([(0, n, v, v, v) for n, v in enumerate(levels)], quantize.PALETTE_SCHEMA)
    got = pens_of(quantize.dither_floyd_steinberg_gray(raster(rows), palette))
    want = diffused([[(v,) for v in line] for line in rows], [(v,) for v in levels])
    assert got == {(0, y, x): p for (y, x), p in want.items()}


def test_floyd_steinberg_does_not_depend_on_batches(spark, folder):
    df = tables.rgb_from_orders(spark, folder)
    palette = quantize.palette_popularity(df, 6)
    want = pens_of(quantize.dither_floyd_steinberg(df, palette))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert pens_of(quantize.dither_floyd_steinberg(df, palette)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_error_limit_table():
    values = np.arange(-255, 256)
    assert quantize.error_limit(values).tolist() == [limited(int(v)) for v in values]


def test_median_cut_two_clusters(raster):
    df = raster([[(0, 0, 0)] * 3 + [(8, 0, 0)], [(248, 252, 248)] * 2 + [(240, 252, 248)] * 2])
    pens = quantize.palette_median_cut(df, 2).orderBy("pen").collect()
    assert [tuple(r)[1:] for r in pens][0] == (0, 0, 0, 0)
    assert len(pens) == 2


def test_median_cut_separates_every_colour_when_there_is_room(spark, folder):
    df = tables.rgb_from_orders(spark, folder).where("image_id = 0 AND y < 4")
    bins = stats.color_histogram_565(df).count()
    pens = quantize.palette_median_cut(df, 256)
    assert pens.count() == bins


def test_median_cut_boxes_hold_all_weight():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 3, (32, 64, 32))
    for colors in (2, 7, 100):
        boxes = quantize.cut_boxes(weights, colors)
        assert sum(b.hits for b in boxes) == weights.sum()
        assert sum(int(np.prod(b.size)) for b in boxes) == weights.size
        assert all(b.hits == b.cells(weights).sum() for b in boxes)


def test_gray_median_cut_levels(raster):
    df = raster([[10] * 8, [20] * 8, [200] * 8, [220] * 8])
    pens = [r["r"] for r in quantize.palette_median_cut_gray(df, 2).orderBy("pen").collect()]
    assert len(pens) == 2 and pens[0] < 100 < pens[1] + 200


@pytest.mark.parametrize("radius", [1, 4, 40])
def test_local_equalisation(raster, cells, radius):
    rows = picture(radius, 12, 17)
    got = cells(stencil.hist_eq_local(raster(rows), radius, rows=5))
    data = np.array(rows)
    for y in range(12):
        for x in range(17):
            patch = data[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
            for c in range(3):
                plane = patch[:, :, c]
                want = 255 * int((plane <= data[y, x, c]).sum()) // plane.size
                assert got[0, y, x][c + 1] == want


@pytest.mark.parametrize("radius", [1, 5])
def test_median_loop(raster, cells, radius):
    rows = picture(radius, 9, 13)
    got = cells(stencil.median(raster(rows), radius, rows=4))
    data = np.array(rows)
    for y in range(9):
        for x in range(13):
            ys = np.clip(np.arange(y - radius, y + radius + 1), 0, 8)
            xs = np.clip(np.arange(x - radius, x + radius + 1), 0, 12)
            patch = data[np.ix_(ys, xs)].reshape(-1, 3)
            assert list(got[0, y, x][1:]) == np.sort(patch, axis=0)[len(patch) // 2].tolist()


def test_estimate_is_close(spark, folder):
    df = tables.rgb_from_orders(spark, folder)
    both = stats.color_count(df).withColumnRenamed("colors", "exact").join(stats.color_count_estimate(df), "image_id")
    assert both.where(F.abs(F.col("exact") - F.col("colors")) > 0.1 * F.col("exact")).count() == 0
