import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixelframe.layout import PIXEL_SCHEMA  # noqa: E402
from pixelframe.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def raster(spark):
    """Pixels from nested lists: gray numbers, (r, g, b) or (a, r, g, b) cells."""

    def build(rows, image_id=0):
        height, width = len(rows), len(rows[0])
        out = []
        for y, line in enumerate(rows):
            for x, cell in enumerate(line):
                if isinstance(cell, int):
                    cell = (cell,) * 3
                a = None if len(cell) == 3 else cell[0]
                out.append((image_id, width, height, y, x, a, *cell[-3:]))
        return spark.createDataFrame(out, PIXEL_SCHEMA)

    return build


@pytest.fixture(scope="session")
def cells():
    """Collected pixels as {(image, y, x): (a, r, g, b)}; fails on a double cell."""

    def read(df):
        rows = df.select("image_id", "y", "x", "a", "r", "g", "b").collect()
        out = {(r[0], r[1], r[2]): tuple(r[3:]) for r in rows}
        assert len(out) == len(rows)
        return out

    return read
