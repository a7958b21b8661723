"""Stateless operators on pixel streams.

Point operators and the shuffle-free remaps are projections and filters, so
they need no state, watermark or window and run on a stream as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..layout import PIXEL_SCHEMA, require
from ..plans.registry import POINT_OPERATORS, Step, recipe


def pixel_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet pixel files under a folder."""
    return (
        spark.readStream.schema(PIXEL_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def stream_recipe(stream: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """A recipe of stateless operators only."""
    steps = list(steps)
    stateful = [name for name, _ in steps if name.upper() not in POINT_OPERATORS]
    require(not stateful, f"not stateless: {', '.join(stateful)}")
    return recipe(stream, steps)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results as Parquet, once over what is available."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
