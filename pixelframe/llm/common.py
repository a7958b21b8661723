"""What several operators share: reading, cutting lineage, neighbours in key order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import fresh_path


ROW_GROUP_BYTES = 16 << 20  # what a writing task holds; whole texts are wide rows


BATCH_ROWS = 1000  # rows that a task moves to or from Python at once


def small_batches(spark: SparkSession) -> None:
    """From here on the session moves few rows at once to Python: whole texts are wide rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(text: Column | str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back; the new plan is one scan."""
    path = fresh_path(df.sparkSession)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: str = "doc_id") -> Column:
    """Rows no model learns from: crc32 of the key as text divisible by 5 (null: "")."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def with_next(df: DataFrame, key: str, tie: Column, cols: list[str], rows_per_bucket: int = 4096,
              keys: DataFrame | None = None) -> DataFrame:
    """Adds next_<col>: the values of the row that follows in ascending (key, tie).

    After the last row comes the first; null keys come first. The key range is dealt
    into at most 65 536 equal buckets; the rows with a bucket's smallest key are copied
    to the bucket before it, so no window spans the table. The driver sees one number
    per bucket. keys: the key column of the same rows, where df is costly to make.
    """
    clash = [f"next_{c}" for c in cols if f"next_{c}" in df.columns]
    if clash:
        raise ValueError(f"columns {clash} exist already")
    keys = df if keys is None else keys
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    low, high = (int(low) - 1, int(high)) if low is not None else (0, 0)
    buckets = max(1, min(n // rows_per_bucket, 1 << 16), 64 if n >= 256 else 1)
    width = (high - low) // buckets + 1
    bucket = F.expr(f"(_key - {low}L) div {width}L")
    place = F.coalesce(F.col(key).cast("long"), F.lit(low))
    keys = keys.select(place.alias("_key")).withColumn("_bucket", bucket)
    df = df.withColumns({"_key": place, "_tie": tie}).withColumn("_bucket", bucket)
    heads = sorted(tuple(r) for r in keys.groupBy("_bucket").agg(F.min("_key")).collect())
    ring = [(b, k, heads[i - 1][0]) for i, (b, k) in enumerate(heads)]
    heads_df = df.sparkSession.createDataFrame(ring, "_bucket long, _head long, _before long")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_before").alias("b"), F.lit(True).alias("copy"))
    dealt = df.join(F.broadcast(heads_df), "_bucket").withColumn(
        "_at", F.explode(F.when(F.col("_key") == F.col("_head"), F.array(own, copy)).otherwise(F.array(own)))
    )
    order = Window.partitionBy("_at.b").orderBy("_at.copy", "_key", "_tie")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in cols}
    drop = ["_key", "_tie", "_bucket", "_head", "_before", "_at"]
    return dealt.withColumns(ahead).where(~F.col("_at.copy")).drop(*drop)
