"""Laws that hold for any raster."""

import pytest
from pyspark.sql import functions as F

from pixelframe.functions import color, noise, tone
from pixelframe.functions.kernels import preset
from pixelframe.layout import RasterArgumentError, as_pixels, attach, density, heads
from pixelframe.operators import combine, geometry, quantize, stats, stencil, watermark
from pixelframe.plans.registry import process, recipe
from pixelframe.sources import files, generate, tables


@pytest.fixture(scope="module")
def rgb(spark, folder):
    return tables.rgb_from_orders(spark, folder, alpha=True)


@pytest.fixture(scope="module")
def uneven(spark):
    """Images of several odd sizes."""
    sizes = spark.createDataFrame([(1, 5, 3), (2, 1, 7), (3, 9, 1), (4, 4, 6), (5, 1, 1)], "image_id long, width int, height int")
    grid = generate.grid(sizes)
    v = (F.col("x") * 37 + F.col("y") * 91 + F.col("image_id") * 13) % 256
    return as_pixels(grid.withColumns({"a": (v + 5) % 256, "r": v, "g": (v * 3) % 256, "b": (v * 7) % 256}))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_identities(uneven):
    df = uneven
    assert same(tone.negative(tone.negative(df)), df)
    assert same(geometry.flip_x(geometry.flip_x(df)), df)
    assert same(geometry.flip_y(geometry.flip_y(df)), df)
    assert same(geometry.roll(geometry.roll(df, 3, -8), -3, 8), df)
    assert same(geometry.rotate_nn(df, 0), df)
    assert same(geometry.rotate_bilinear(df, 0), df)
    assert same(geometry.scale_quick(df, F.col("width"), F.col("height")), df)
    assert same(geometry.shift(df, 0, 0), df)
    assert same(color.color_mix(df), df)
    assert same(tone.brightness(df, 0.0), df)


def test_crop_undoes_resize(rgb):
    wide = geometry.resize_canvas(rgb, 40, 50, "border")
    assert same(geometry.crop(wide, 4, 9, 36, 41), rgb)


REMAPS = {
    "resize": lambda df: geometry.resize_canvas(df, 8, 8, "background"),
    "border": lambda df: geometry.resize_canvas(df, 8, 8, "border"),
    "shift": lambda df: geometry.shift(df, -2, 3),
    "far shift": lambda df: geometry.shift(df, 20, 3),
    "shear_h": lambda df: geometry.shear_h(df, -40),
    "shear_v": lambda df: geometry.shear_v(df, 40),
    "rotate 33": lambda df: geometry.rotate_nn(df, 33),
    "rotate 90": lambda df: geometry.rotate_nn(df, 90),
    "rotate -120": lambda df: geometry.rotate_bilinear(df, -120),
    "twirl": lambda df: geometry.twirl_bilinear(df, 90, 4, 2, 2),
    "quick": lambda df: geometry.scale_quick(df, 7, 4),
    "average": lambda df: geometry.scale_average(df, 3, 8),
    "median": lambda df: stencil.median(df, 2, rows=2),
    "local": lambda df: stencil.hist_eq_local(df, 3, rows=2),
    "convolve": lambda df: stencil.convolve(df, preset("average5")),
    "blur": lambda df: stencil.box_blur_separable(df, 2),
    "autocrop": lambda df: geometry.autocrop(df, 1, 2),
}


@pytest.mark.parametrize("name", sorted(REMAPS))
def test_dense_after(name, uneven):
    report = density(REMAPS[name](uneven))
    assert report.count() == 5
    assert report.where("NOT dense").count() == 0


def test_histogram_counts_every_pixel(rgb):
    total = rgb.count()
    hist = stats.channel_histogram(rgb).groupBy("channel").agg(F.sum("n").alias("n"))
    assert {r["n"] for r in hist.collect()} == {total}


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_tiles_do_not_show(uneven, rgb, tile):
    """Tile size, and with it the halo exchange, leaves no trace."""
    for df in (uneven, rgb):
        assert same(stencil.median(df, 2, rows=tile), stencil.median(df, 2, rows=128))
        assert same(stencil.hist_eq_local(df, 5, rows=tile), stencil.hist_eq_local(df, 5, rows=128))


def test_blur_equals_average_kernel(uneven):
    for radius, name in ((1, "average3"), (2, "average5"), (3, "average7")):
        assert same(stencil.box_blur_separable(uneven, radius), stencil.convolve(uneven, preset(name)))


def test_mapping_is_idempotent(rgb):
    palette = quantize.palette_popularity(rgb, 16)
    once = quantize.expand_indexed(quantize.map_to_palette(rgb, palette, 16), palette)
    twice = quantize.expand_indexed(quantize.map_to_palette(once.drop("pen"), palette, 16), palette)
    assert same(once.select(*twice.columns), twice)


def test_both_ways_of_mapping_agree(rgb):
    palette = quantize.palette_popularity(rgb, 20)
    direct = quantize.map_to_palette(rgb, palette, 20).select("image_id", "y", "x", "pen")
    joined = quantize.map_to_palette(rgb, palette, 200).select("image_id", "y", "x", "pen")
    assert same(direct, joined)


def test_partitioning_does_not_matter(rgb):
    """Same rows from one partition or many, in any order."""
    few, many = rgb.coalesce(1), rgb.repartition(13, "x")
    for run in (
        lambda df: noise.noise_additive(df, 30, 50, seed=9),
        lambda df: stencil.convolve(df, preset("gauss8")),
        lambda df: geometry.scale_average(df, 11, 50),
        lambda df: geometry.rotate_bilinear(df, 17),
        lambda df: stats.hist_eq_global(df),
        lambda df: quantize.dither_floyd_steinberg(df, quantize.palette_popularity(df, 4)),
        lambda df: quantize.palette_median_cut(df, 9),
    ):
        assert same(run(few), run(many))


def test_watermark_round_trip(spark, rgb):
    loads = spark.createDataFrame(
        [(0, "a.bin", bytes(range(256))), (1, "empty", b"")], "image_id long, name string, payload binary"
    )
    marked = watermark.embed(rgb, loads, "key", "argb")
    found = {r[0]: (r[1], bytes(r[2])) for r in watermark.assemble(watermark.extract(marked, "key", "argb")).collect()}
    assert found == {0: ("a.bin", bytes(range(256)))}
    assert watermark.extract(marked, "other", "argb").count() == 0
    for c in "argb":
        assert marked.where(F.col(c).isNull()).count() == 0
    changed = marked.alias("m").join(rgb.alias("o"), ["image_id", "y", "x"])
    assert changed.where(" OR ".join(f"abs(m.{c} - o.{c}) > 1" for c in "argb")).count() == 0


def test_watermark_positions_are_a_bijection(rgb):
    keyed = attach(rgb.where("image_id = 0"), watermark.rotations(rgb, "k", "argb"))
    n = watermark._bit_number(F.col("y"), F.col("x") * 4)
    back = watermark._position(F.col("n"))
    out = keyed.withColumn("n", n).withColumns({"by": back[0], "bx": back[1]})
    assert out.where("by <> y OR bx <> x * 4").count() == 0
    assert out.select("n").distinct().count() == 1024


def test_watermark_too_long_is_refused(spark, rgb):
    loads = spark.createDataFrame([(0, "big", bytes(600))], "image_id long, name string, payload binary")
    assert [r["fits"] for r in watermark.fits(rgb, loads, "argb").collect()] == [False]
    assert same(watermark.embed(rgb, loads, "k", "argb", refused="skip"), rgb)
    with pytest.raises(Exception, match="too long"):
        watermark.embed(rgb, loads, "k", "argb").collect()


def test_salted_attach_equals_broadcast(rgb):
    table = stats.background_color(rgb).toDF("image_id", "br", "bg", "bb")
    assert same(attach(rgb, table, rows=2), attach(rgb, table).select(*attach(rgb, table, rows=2).columns))


def test_popular_source_is_dealt_like_a_broadcast(rgb, monkeypatch):
    """One source for every destination, with tiny parts: same result either way."""
    monkeypatch.setattr(combine, "PAIRS_PER_PART", 1)
    pairs = heads(geometry.scale_quick(rgb, 16, 16)).select(
        F.col("image_id").alias("dst_id"), F.lit(0).cast("bigint").alias("src_id"), F.lit(2).alias("top"), F.lit(-3).alias("left"))
    assert same(combine.place(rgb, pairs), combine.place(rgb, pairs, rows=2))


def test_strips_round_trip(rgb):
    assert same(files.from_strips(files.to_strips(rgb)), rgb)


def test_process_and_recipe(rgb):
    assert same(process(rgb, "negative"), tone.negative(rgb))
    assert same(recipe(rgb, [("NEGATIVE", {}), ("Negative", {})]), rgb)
    with pytest.raises(RasterArgumentError):
        process(rgb, "EMBIGGEN")


def test_two_level_rank_is_exact(spark, folder):
    """Any bucket size gives the same rank."""
    reference = tables.rgb_from_lineitem(spark, folder)
    assert density(reference).where("NOT dense").count() == 0
    assert same(tables.rgb_from_lineitem(spark, folder, rows_per_bucket=7), reference)
    counts = spark.range(10_000).selectExpr("id % 3 AS k", "id AS b", "id % 5 AS n")
    small = tables.prefix_offsets(counts, "k", "b", fan=16)
    assert same(small, tables.prefix_offsets(counts, "k", "b"))


def test_byte_plot_holds_every_byte(spark):
    texts = ["", "plain", "naïve ☃ \U0001F600" * 9, "x" * 64, "\x00\x01\x7f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = tables.byte_plot(df, "doc_id", "text").orderBy("image_id", "y", "x").collect()
    for i, text in enumerate(texts):
        raw = text.encode()
        values = [r["r"] for r in rows if r["image_id"] == i]
        assert bytes(values) == raw + bytes(-len(raw) % 64)
