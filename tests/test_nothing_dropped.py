"""Nothing is lost silently: images outside a region, without a palette, gaps, sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.layout import PIXEL_SCHEMA, density
from pixelframe.operators import catalog, geometry, quantize, regions, stats, stencil
from pixelframe.functions import color
from pixelframe.functions.kernels import PRESETS, Kernel
from pixelframe.plans.registry import process
from pixelframe.sources import files, generate, tables

PENS = "image_id long, pen int, r int, g int, b int"


@pytest.fixture()
def two(raster):
    """An 8 x 8 and a 3 x 3 image."""
    big = [[(x * 30, y * 30, 100) for x in range(8)] for y in range(8)]
    small = [[(200, x * 50, y * 50) for x in range(3)] for y in range(3)]
    return raster(big, 0).unionByName(raster(small, 1))


def sizes(df):
    return dict(df.groupBy("image_id").count().collect())


def test_equalisation_keeps_images_outside_the_region(two, cells):
    out = stats.hist_eq_global(two, regions.rect(4, 4, 8, 8))
    assert sizes(out) == {0: 64, 1: 9}
    before, after = cells(two), cells(out)
    assert all(after[k] == v for k, v in before.items() if k[0] == 1)


@pytest.mark.parametrize("pens", [4, 200])
def test_images_without_a_palette_stay(spark, two, pens):
    palette = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 7, 255, 255, 255)], PENS)
    for out in (quantize.map_to_palette(two, palette, pens), quantize.map_gray_to_palette(two, palette),
                quantize.dither_floyd_steinberg(two, palette)):
        assert sizes(out) == {0: 64, 1: 9}
        assert {r.pen for r in out.where("image_id = 0").collect()} <= {0, 7}
        assert {r.pen for r in out.where("image_id = 1").collect()} == {None}


def test_pens_are_numbers_not_positions(spark, raster):
    df = raster([[0, 255, 130]])
    palette = spark.createDataFrame([(0, 3, 0, 0, 0), (0, 9, 255, 255, 255)], PENS)
    for out in (quantize.map_to_palette(df, palette), quantize.map_gray_to_palette(df, palette), quantize.dither_floyd_steinberg_gray(df, palette)):
        assert [r.pen for r in out.orderBy("x").collect()][:2] == [3, 9]
    back = quantize.expand_indexed(quantize.map_to_palette(df, palette), palette)
    assert [r.r for r in back.orderBy("x").collect()] == [0, 255, 255]


def test_white_stays_white(raster):
    df = raster([[(255, 255, 255), (255, 255, 255)], [(0, 0, 0), (255, 255, 255)]])
    for palette in (quantize.palette_popularity(df, 2), quantize.palette_median_cut(df, 2)):
        assert {tuple(r[2:]) for r in palette.collect()} == {(255, 255, 255), (0, 0, 0)}


def test_median_cut_keeps_the_brightest(raster):
    df = raster([list(range(0, 256, 4))])
    pens = [r.r for r in quantize.palette_median_cut_gray(df, 4).orderBy("pen").collect()]
    assert len(pens) == 4 and pens == sorted(pens) and pens[-1] == 222  # the mean of 192 to 252
    assert len(quantize.palette_median_cut_gray(raster([[5, 5, 250]]), 4).collect()) == 2


def test_median_cut_has_no_box_cap():
    weights = np.ones(4096, dtype=np.int64)
    boxes = quantize.cut_boxes(weights, 1000)
    assert len(boxes) == 1000 and sum(b.hits for b in boxes) == 4096


def test_sizes_out_of_range_are_errors(spark):
    bad = spark.createDataFrame([(1, 20_000, 2)], "image_id long, width int, height int")
    with pytest.raises(Exception, match="size out of range"):
        generate.constant_raster(bad, (1, 2, 3)).collect()


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"not an image")
    assert [r.path.endswith("a.png") for r in files.rejected_images(spark, str(tmp_path)).collect()] == [True]
    with pytest.raises(Exception, match="cannot decode"):
        files.load_images(spark, str(tmp_path), invalid="raise").collect()
    assert files.load_images(spark, str(tmp_path)).count() == 0


def test_gaps_in_keys_are_filled(spark):
    keys = [0, 1, 5, 8, 9, 10, 11, 17]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = sorted(r.k for r in tables.missing_keys(df, "k", 4).collect())
    assert found == [2, 3, 4, 6, 7, 16, 18, 19]


def test_strong_reduction_is_a_mean(spark):
    n = 9000
    rows = [(0, n, 1, 0, x, None, 10 if x < n // 2 else 200, x % 2 * 100, 7) for x in range(n)]
    out = geometry.scale_average(spark.createDataFrame(rows, PIXEL_SCHEMA), 2, 1).orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in out] == [(10, 50, 7), (200, 50, 7)]


def test_find_frame_by_table(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "image_id long, name string")
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    assert sorted(r.image_id for r in catalog.find_frame(images, names).collect()) == [1, 3]
    assert [r.image_id for r in catalog.find_frame(images, "b").collect()] == [2]


def test_ids_with_equal_low_bits_are_dealt_over_slots(spark):
    ids = spark.range(64).select((F.col("id") * 2**32).alias("image_id"), (F.col("id") % 2).cast("int").alias("palette_id"))
    pens = spark.createDataFrame([(p, n, n, n, n) for p in (0, 1) for n in range(3)], "palette_id int, pen int, r int, g int, b int")
    assert quantize.palette_force(ids, pens).count() == 64 * 3
    slots = ids.select(F.pmod(F.xxhash64("image_id"), F.lit(32)).alias("s")).distinct().count()
    assert slots > 16


def test_tiles_do_not_show(raster):
    rng = np.random.default_rng(3)
    df = raster([[tuple(int(v) for v in rng.integers(0, 256, 3)) for _ in range(40)] for _ in range(30)])
    kernels = [Kernel.of(*e) for e in PRESETS]
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(stencil.convolve_each(df, kernels, rows=7)) == rows(stencil.convolve_each(df, kernels))


def test_background_transparency(raster, cells):
    df = raster([[(9, 9, 9), (100, 0, 0)], [(9, 9, 9), (9, 9, 9)]])
    out = cells(color.transparency(df, 200, tolerance=60, background=True))
    assert out[(0, 0, 0)][0] == 200 and out[(0, 0, 1)][0] == 0


def test_black_and_white_pens(spark):
    pens = spark.createDataFrame([(0, 0, 250, 250, 250), (0, 1, 9, 9, 9), (0, 2, 90, 0, 0)], PENS)
    got = {r.pen: (r.r, r.g, r.b) for r in quantize.palette_black_white(pens).collect()}
    assert got == {0: (0, 0, 0), 1: (255, 255, 255), 2: (90, 0, 0)}


def test_two_raster_operators_by_name(two):
    out = process(two, "render", colors=4)
    assert sizes(out) == {0: 64, 1: 9} and out.columns == two.columns
    assert process(two, "colorcount").count() == 2


def test_vectors_of_any_length_and_null_make_dense_rasters(spark):
    rows = [(0, [0.25] * 64), (1, None), (2, [0.25] * 70), (5, [0.25] * 3), (63, [None] * 64), (70, []), (-1, [0.25] * 64), (-64, None), (None, [0.1])]
    df = tables.gray_lines(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert density(df).where("dense").count() == density(df).count() == 3
    value = 128 + 55
    held = {(r.image_id, r.y): r.n for r in df.where(F.col("r") == value).groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held == {(0, 0): 64, (0, 2): 64, (0, 5): 3, (-1, 63): 64}
    assert df.where("r not in (0, 183)").count() == 0


def test_empty_texts_are_listed(spark):
    df = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(r.image_id for r in tables.unplotted(df).collect()) == [2, 3]
    assert {r.image_id for r in tables.byte_plot(df, "doc_id", "text").collect()} == {1}
