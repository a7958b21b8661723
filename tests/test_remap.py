"""Recipes of canvas steps: one map, the same pixels as step by step."""

import random

import pytest

from pixelframe.layout import PIXEL_SCHEMA, RasterArgumentError
from pixelframe.operators import remap
from pixelframe.plans.registry import process, recipe
from pixelframe.sources import tables


def pixels(spark):
    rng = random.Random(4)
    out = []
    for image, (w, h), alpha in ((1, (7, 5), False), (2, (3, 9), True), (9, (1, 1), True), (-4, (12, 4), False)):
        for y in range(h):
            for x in range(w):
                out.append((image, w, h, y, x, rng.randrange(256) if alpha else None, *[rng.randrange(256) for _ in range(3)]))
    return spark.createDataFrame(out, PIXEL_SCHEMA)


def one_by_one(df, steps):
    """Every step on the collected pixels of the one before."""
    for name, arguments in steps:
        df = process(df.sparkSession.createDataFrame(df.collect(), PIXEL_SCHEMA), name, **arguments)
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def some_step(rng):
    kind = rng.randrange(7)
    if kind == 0:
        x0, y0 = rng.randrange(3), rng.randrange(3)
        return "CROP", {"x0": x0, "y0": y0, "x1": x0 + rng.randint(1, 9), "y1": y0 + rng.randint(1, 9)}
    if kind in (1, 2):
        return ("ROLL", "SHIFT")[kind - 1], {"dx": rng.randint(-6, 6), "dy": rng.randint(-6, 6)}
    if kind in (3, 4):
        return ("FLIPX", "FLIPY")[kind - 3], {}
    if kind == 5:
        return "RESIZE", {"width": rng.randint(1, 14), "height": rng.randint(1, 14), "fill": rng.choice(["black", "white"])}
    return "SCALE", {"new_width": rng.randint(1, 12), "new_height": rng.randint(1, 12)}


@pytest.mark.parametrize("seed", range(8))
def test_same_pixels(spark, seed):
    rng = random.Random(seed)
    steps = [some_step(rng) for _ in range(5)]
    df = pixels(spark)
    assert rows(recipe(df, steps)) == rows(one_by_one(df, steps)), steps


def test_other_steps_stay_in_their_place(spark):
    steps = [("SHIFT", {"dx": 2}), ("ROLL", {"dx": 1, "dy": 1}), ("NEGATIVE", {}), ("RESIZE", {"width": 9, "height": 9, "fill": "border"}),
             ("flipx", {}), ("Shift", {"dy": -1}), ("FLIPY", {"box": (0, 0, 3, 2)})]
    df = pixels(spark)
    assert rows(recipe(df, steps)) == rows(one_by_one(df, steps))


def test_twenty_steps_read_the_source_twice(spark, folder):
    steps = [("SHIFT", {"dx": 3, "dy": -2}), ("RESIZE", {"width": 40, "height": 44, "fill": "white"}), ("FLIPX", {}), ("ROLL", {"dx": 5, "dy": 7}),
             ("CROP", {"x0": 1, "y0": 2, "x1": 39, "y1": 41})] * 4
    df = tables.bytes_from_documents(spark, folder)
    plan = recipe(df, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
    df = pixels(spark)
    short = steps[:10]
    assert rows(recipe(df, short)) == rows(one_by_one(df, short))


def test_arguments_are_checked(spark):
    assert remap.step("RESIZE", {"width": 3, "height": 3, "fill": "background"}) is None
    assert remap.step("ROTATE", {"angle": 3}) is None
    for bad in (("CROP", {"x0": 3, "y0": 0, "x1": 3, "y1": 2}), ("RESIZE", {"width": 0, "height": 3})):
        with pytest.raises(RasterArgumentError):
            recipe(pixels(spark), [("FLIPX", {}), bad])
    with pytest.raises(RasterArgumentError):
        recipe(pixels(spark), [("NO SUCH STEP", {})])
