"""Scan lines as bytes: nothing is lost on the way, and bands do not show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions.kernels import preset
from pixelframe.layout import PIXEL_SCHEMA
from pixelframe.operators import lines, stats, stencil


def picture(seed, height, width, alpha):
    rng = np.random.default_rng(abs(seed))
    out = []
    for y in range(height):
        for x in range(width):
            a = None if alpha == "none" or (alpha == "some" and (x + y) % 3 == 0) else int(rng.integers(0, 256))
            out.append((seed, width, height, y, x, a, *map(int, rng.integers(0, 256, 3))))
    return out


@pytest.fixture(scope="module")
def pixels():
    out = picture(1, 9, 13, "none") + picture(2, 5, 7, "all") + picture(-3, 30, 3, "some") + picture(4, 1, 1, "none")
    gray = [(7, 20, 20, y, x, None, *[(x * y) % 256] * 3) for y in range(20) for x in range(20)]
    holes = [p for p in picture(9, 11, 17, "some") if (p[3] * 17 + p[4]) % 5 and p[3] != 4]
    wide = picture(5, 2, 16383, "none")
    return out + gray + holes + wide


@pytest.mark.parametrize("rows", [None, 1, 4])
def test_round_trip(spark, pixels, rows):
    df = spark.createDataFrame(pixels, PIXEL_SCHEMA).repartition(7, "r")
    found = lines.banded(df, 2, lambda view, top, n: view[top : top + n], rows)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(pixels, key=str)


def test_fragments_are_about_the_lines(spark, pixels):
    """What is shuffled between packing and bands: a row a line, not a row a pixel."""
    whole = [p for p in pixels if p[0] != 9]
    df = spark.createDataFrame(whole, PIXEL_SCHEMA).repartition(7, "r")
    found = lines.packed(df)
    assert found.count() == len({(p[0], p[3]) for p in whole})
    assert found.agg(F.sum(F.octet_length("rgb"))).first()[0] == 3 * len(whole)


def test_empty(spark):
    df = spark.createDataFrame([], PIXEL_SCHEMA)
    assert stencil.convolve(df, preset("gauss8")).collect() == []
    assert stencil.median(df, 4).collect() == []


@pytest.mark.parametrize("radius", [3, 64])
def test_moving_histograms(radius):
    """Counts of the moving window against counting every window."""
    rng = np.random.default_rng(radius)
    plane = rng.integers(0, 256, (150, 140), dtype=np.uint8)
    moving = stencil.ColumnHistograms(plane, radius)
    for y in range(0, 150):
        sums = moving.move(y)
        if y % 37:
            continue
        for x in (0, 1, 70, 139):
            own = plane[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
            upto = sums[min(140, x + radius + 1)] - sums[max(0, x - radius)]
            assert [int((own <= v).sum()) for v in moving.levels] == upto.tolist()


def test_wide_median_against_numpy(spark):
    rng = np.random.default_rng(8)
    own = rng.integers(0, 256, (40, 33, 3))
    df = spark.createDataFrame(
        [(1, 33, 40, y, x, None, *map(int, own[y, x])) for y in range(40) for x in range(33)], PIXEL_SCHEMA)
    wide = np.pad(own, ((4, 4), (4, 4), (0, 0)), mode="edge")
    for r in stencil.median(df, 4, rows=9).collect():
        window = wide[r.y : r.y + 9, r.x : r.x + 9].reshape(-1, 3)
        assert (r.r, r.g, r.b) == tuple(int(v) for v in np.sort(window, axis=0)[40])


def test_pixels_are_packed_before_they_are_shuffled(spark, pixels):
    """What reaches the bands is fragments; no pixel is gathered or sorted in a shuffle."""
    df = spark.createDataFrame(pixels, PIXEL_SCHEMA)
    for found in (stencil.convolve(df, preset("gauss4")), stencil.box_blur_separable(df, 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan
        assert plan.rindex("MapInArrow") > plan.index("Exchange")
    gray = df.where("image_id = 7").coalesce(1)
    assert [tuple(r) for r in lines.fragments(gray).select("n", F.octet_length("rgb")).distinct().collect()] == [(20, 20)]


def test_blur_is_an_average_and_keeps_a_missing_image_number(spark):
    rng = np.random.default_rng(4)
    for key in (3, None):
        old = rng.integers(0, 256, (70, 9, 3))
        rows = [(key, 9, 70, y, x, 5, *map(int, old[y, x])) for y in range(70) for x in range(9)]
        df = spark.createDataFrame(rows, PIXEL_SCHEMA).repartition(3)
        wide = np.pad(old, ((2, 2), (2, 2), (0, 0)))
        want = sum(wide[i:i + 70, j:j + 9] for i in range(5) for j in range(5)) // 25
        found = {(r.y, r.x): (r.image_id, r.a, r.r, r.g, r.b) for r in stencil.box_blur_separable(df, 2).collect()}
        assert found == {(y, x): (key, 5, *map(int, want[y, x])) for y in range(70) for x in range(9)}


def test_equalisation_meets_lines_not_pixels(spark, pixels):
    """Images not proven few: the same as by broadcast, and no pixel in a shuffle."""
    tall = [(11, 2, 1200, y, x, None, *[(y * 7 + x) % 200] * 3) for y in range(1200) for x in range(2)]
    lost = [(None, *p[1:]) for p in picture(6, 4, 5, "some")]
    df = spark.createDataFrame(pixels + tall + lost, PIXEL_SCHEMA).repartition(5)
    out = stats.hist_eq_global(df)
    assert sorted(map(tuple, out.where("image_id is not null").collect()), key=str) == sorted(
        map(tuple, stats.hist_eq_global(df, rows=8).where("image_id is not null").collect()), key=str)
    assert sorted(map(tuple, out.where("image_id is null").collect()), key=str) == sorted(lost, key=str)
    first = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in first.split("Exchange")[0] and "Broadcast" not in first


def test_equalisation_keeps_pixels_without_a_sample(spark, pixels):
    df = spark.createDataFrame([*pixels[:20], (1, 13, 9, 8, 12, None, None, 4, 5)], PIXEL_SCHEMA)
    assert stats.hist_eq_global(df).where("r is null").count() == 1


def test_blur_of_repeated_pixels(spark):
    """Neighbours are the pixels next in order, as in windows over a line and a column."""
    old = np.random.default_rng(8).integers(0, 256, (5, 4))
    rows = [(1, 4, 5, y, x, None, *[int(old[y, x])] * 3) for y in range(5) for x in range(4)]
    seen = {}
    twice = np.repeat(old, 2, axis=1)
    line = sum(np.pad(twice, ((0, 0), (1, 1)))[:, i:i + 8] for i in range(3))
    for x in range(4):
        column = np.pad(line[:, 2 * x:2 * x + 2].reshape(-1), 1)
        for i, v in enumerate(sum(column[j:j + 10] for j in range(3)) // 9):
            seen.setdefault((i // 2, x), []).append(int(v))
    found = {}
    for r in stencil.box_blur_separable(spark.createDataFrame(rows * 2, PIXEL_SCHEMA), 1).collect():
        found.setdefault((r.y, r.x), []).append(r.r)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(min(255, n) for n in v) for k, v in seen.items()}
