"""Image files, sinks and streams."""

import struct
import zlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pixelframe.functions import tone
from pixelframe.layout import RasterArgumentError, density
from pixelframe.operators import quantize
from pixelframe.sources import files, images, tables
from pixelframe.streaming import points


def png(rows, channels):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    kind = {1: 0, 3: 2, 4: 6}[channels]
    header = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    raw = b"".join(b"\0" + bytes(v for cell in line for v in cell) for line in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_one(spark, cells, path):
    df = files.load_images(spark, str(path))
    assert density(df).where("NOT dense").count() == 0
    return {k[1:]: v for k, v in cells(df).items()}


def test_load_rgb(spark, cells, tmp_path):
    rows = [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 20, 30), (40, 50, 60), (70, 80, 90)]]
    (tmp_path / "a.png").write_bytes(png(rows, 3))
    got = read_one(spark, cells, tmp_path)
    assert got == {(y, x): (None, *rows[y][x]) for y in range(2) for x in range(3)}


def test_load_alpha_becomes_transparency(spark, cells, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[(1, 2, 3, 255), (4, 5, 6, 0)]], 4))
    assert read_one(spark, cells, tmp_path) == {(0, 0): (0, 1, 2, 3), (0, 1): (255, 4, 5, 6)}


def test_load_gray(spark, cells, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[(5,), (250,)]], 1))
    assert read_one(spark, cells, tmp_path) == {(0, 0): (None, 5, 5, 5), (0, 1): (None, 250, 250, 250)}


def test_load_many_tall(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(png([[(i, y % 256, 7)] for y in range(600)], 3))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    df = files.load_images(spark, str(tmp_path))
    assert df.count() == 3000
    assert df.where("g <> y % 256").count() == 0


def test_sniff_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(png([[(0, 0, 0)]], 3))
    (tmp_path / "y.TGA").write_bytes(b"BM not really")
    (tmp_path / "z").write_bytes(b"nothing")
    found = {r["path"].split("/")[-1]: r["format"] for r in files.sniff_files(spark, str(tmp_path)).collect()}
    assert found == {"x.bin": "png", "y.TGA": "targa", "z": None}


def test_save_and_load(spark, folder, tmp_path):
    df = tables.rgb_from_orders(spark, folder)
    path = str(tmp_path / "out")
    files.save_truecolor(df, path)
    back = files.load_pixels(spark, path)
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    with pytest.raises(AnalysisException):
        files.save_truecolor(df, path)
    files.save_truecolor(df.where("y < 3"), path, overwrite=True)
    assert files.load_pixels(spark, path).count() == 2 * 32 * 3


def test_save_refuses_colorspace(spark, folder, tmp_path):
    spaces = spark.createDataFrame([(0, "LUT")], "image_id long, colorspace string")
    with pytest.raises(RasterArgumentError):
        files.save_truecolor(tables.rgb_from_orders(spark, folder), str(tmp_path / "no"), spaces)
    assert not (tmp_path / "no").exists()


def test_region_filter_reaches_the_scan(spark, folder, tmp_path):
    from pixelframe.operators.regions import rect

    path = str(tmp_path / "out")
    files.save_truecolor(tables.rgb_from_orders(spark, folder), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = files.load_pixels(spark, path).where(rect(1, 2, 9, 8)).where("image_id = 1").select("r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,2)" in plan and "EqualTo(image_id,1)" in plan
    assert "a:int" not in plan.split("ReadSchema")[1]


def test_save_indexed(spark, folder, tmp_path):
    df = tables.rgb_from_orders(spark, folder)
    indexed, palettes = quantize.render_indexed(df, 8, "none", "median_cut")
    files.save_indexed(indexed, palettes, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o/indexed_pixels")).count() == df.count()
    assert spark.read.parquet(str(tmp_path / "o/palettes")).groupBy("image_id").count().count() == 2


def test_save_indexed_leaves_nothing(spark, folder, tmp_path):
    df = tables.rgb_from_orders(spark, folder)
    indexed, palettes = quantize.render_indexed(df, 8, "none", "median_cut")
    fails = indexed.withColumn("pen", F.when(F.col("y") == 31, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("pen")))
    with pytest.raises(Exception, match="lost"):
        files.save_indexed(fails, palettes, str(tmp_path / "o"))
    assert list(tmp_path.iterdir()) == []
    files.save_indexed(indexed, palettes, str(tmp_path / "o"))
    with pytest.raises(RasterArgumentError):
        files.save_indexed(indexed, palettes, str(tmp_path / "o"))
    with pytest.raises(Exception, match="lost"):  # the old tables stay
        files.save_indexed(fails, palettes, str(tmp_path / "o"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "o/indexed_pixels")).count() == df.count()
    files.save_indexed(indexed.where("y < 3"), palettes, str(tmp_path / "o"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "o/indexed_pixels")).count() == 2 * 32 * 3
    assert [p.name for p in tmp_path.iterdir()] == ["o"]


def file_number(origin):
    return F.regexp_extract(origin, r"(\d+)\.png$", 1)


@pytest.mark.parametrize("alpha", [False, True])
def test_save_images(spark, raster, cells, tmp_path, alpha):
    cell = lambda i, y, x: ((x * 9 % 256,) if alpha else ()) + ((i * 7 + x) % 256, 255 - y, (128 + x * y) % 256)
    rows = [[[cell(i, y, x) for x in range(40 + i)] for y in range(30)] for i in range(5)]
    df = raster(rows[0], 0)
    for i in range(1, 5):
        df = df.union(raster(rows[i], i))
    path = str(tmp_path / "o")
    images.save_images(df, path, alpha)
    back = files.load_images(spark, path, file_number)
    assert back.count() == df.count() and back.select(df.columns).exceptAll(df).count() == 0
    with pytest.raises(RasterArgumentError):
        images.save_images(df, path, alpha)
    images.save_images(df.where("image_id = 3"), path, alpha, overwrite=True)
    assert [p.name for p in (tmp_path / "o").rglob("*.png")] == ["3.png"]
    assert [p.name for p in tmp_path.iterdir()] == ["o"]


def test_save_images_fails_as_a_whole(spark, raster, tmp_path):
    whole = raster([[(1, 2, 3)] * 4] * 3, 1)
    for broken in (raster([[(1, 2, 3)] * 4] * 3, 2).where("y <> 1"), raster([[(9, 1, 2, 3)] * 4] * 3, 2),
                   raster([[(1, 2, 3)] * 4] * 3, 2).where("y < 2"), raster([[(1, 2, 3)] * 4] * 3, 2).where("x <> 2")):
        with pytest.raises(Exception, match="image 2|alpha"):
            images.save_images(whole.union(broken), str(tmp_path / "o"))
        assert list(tmp_path.iterdir()) == []


STEPS = [("BRIGHTNESS", {"amount": 0.2}), ("NEGATIVE", {}), ("FLIPX", {}), ("CROP", dict(x0=2, y0=1, x1=30, y1=31))]


def test_stream_equals_batch(spark, folder, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = tables.rgb_from_orders(spark, folder)
    df.repartition(6, "y").write.parquet(source)
    stream = points.stream_recipe(points.pixel_stream(spark, source, 2), STEPS)
    points.write_stream(stream, out, str(tmp_path / "check")).awaitTermination()
    got, want = spark.read.parquet(out), points.stream_recipe(df, STEPS)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stream_refuses_stateful_steps(spark, folder):
    with pytest.raises(RasterArgumentError):
        points.stream_recipe(tables.rgb_from_orders(spark, folder), [("CONVOLUTE", {"kernel": "gauss4"})])


def test_pixel_stream_schema(spark, tmp_path):
    assert tone.negative(points.pixel_stream(spark, str(tmp_path))).isStreaming
