"""Joins whose small side has no stated bound are shuffled, however small its files look."""

import pytest
from pyspark.sql import functions as F

from pixelframe.operators import catalog, combine, regions


def plan(df):
    df.collect()  # adaptive execution may still turn a join into a broadcast
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def pair(raster):
    return raster([[10, 20], [30, 40]], 1).unionByName(raster([[50] * 70, [60] * 70], 2))


def test_attached_frames_are_not_broadcast(spark):
    images = spark.createDataFrame([(7, 3, 4)], "image_id long, width int, height int")
    pairs = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 8, 2)], "dst_id long, src_id long, seq int")
    out = combine.attach_frames(pairs, images)
    assert "Broadcast" not in plan(out)
    assert sorted(tuple(r) for r in out.select("dst_id", "src_width").collect()) == [(1, 3), (2, 3)]


def test_deleted_frames_are_not_broadcast(spark, pair):
    out = catalog.delete_frame(pair, spark.createDataFrame([(2,), (2,), (None,)], "image_id long"))
    assert "Broadcast" not in plan(out)
    assert {r.image_id for r in out.collect()} == {1}


def test_region_tables_are_not_broadcast(spark, pair):
    spots = [(1, 1, 0), (2, 0, 63), (2, 0, 64), (2, 0, 69), (2, 1, 0), (2, 0, 64), (9, 0, 0)]
    out = regions.in_region_table(pair, spark.createDataFrame(spots, "image_id long, y int, x int"))
    assert "Broadcast" not in plan(out)
    hit = [tuple(r) for r in out.where("selected").select("image_id", "y", "x").collect()]
    assert sorted(hit) == sorted(set(spots) - {(9, 0, 0)})
    assert out.count() == pair.count() and out.where(F.col("selected").isNull()).count() == 0
