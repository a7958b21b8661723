"""Rasters bound to ordinary tables.

The bindings place a row by arithmetic on its dense key (no ranking, no
shuffle); ``rgb_from_lineitem`` has no such key and ranks in two levels. Keys
that an image lacks, inside or at the end, become black pixels; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..layout import as_pixels, clamp8, idiv, span

GRAY_SIDE = 64  # embeddings have 64 dimensions; 64 vectors make one image
RGB_SIDE = 32
RGB_CELLS = RGB_SIDE * RGB_SIDE
BYTE_WIDTH = 64


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def widen(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan with fewer splits than cores over all cores.

    For tables about to be expanded into many more rows. A large table has
    plenty of splits and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def block_of(key: Column, block: int) -> Column:
    """Which block of consecutive keys a key is in; also right below zero."""
    return idiv(key - F.pmod(key, F.lit(block)), block)


def missing_keys(df: DataFrame, key: str, block: int) -> DataFrame:
    """Keys that complete each block of ``block`` keys of which the table has some.

    A block's keys are gathered as places inside it, at most ``block`` small numbers.
    """
    place = F.pmod(F.col(key), F.lit(block)).cast("int")
    known = df.where(F.col(key).isNotNull())
    blocks = known.groupBy(block_of(F.col(key), block).alias("_block")).agg(F.collect_set(place).alias("_held"))
    free = F.array_except(F.sequence(F.lit(0), F.lit(block - 1)), "_held")
    return blocks.where(F.size("_held") < block).select(
        F.explode(F.transform(free, lambda p: F.col("_block") * block + p)).alias("k")
    )


def gray_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """A vector is a scan line, a dimension is a column."""
    return gray_lines(read_table(spark, folder, "embeddings"), "vec_id", "embedding")


def gray_lines(table: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors as scan lines, GRAY_SIDE consecutive keys an image.

    A null vector is a black line, a shorter one ends in black pixels and of a longer one
    the first GRAY_SIDE numbers count. A row without a key has no place and is left out.
    """
    nothing = F.array_repeat(F.lit(None), GRAY_SIDE).cast(table.schema[vector].dataType)
    sized = F.slice(F.coalesce(F.concat(F.col(vector), nothing), nothing), 1, GRAY_SIDE)
    lines = table.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), sized.alias("embedding"))
    blank = missing_keys(table, key, GRAY_SIDE).select("k", nothing.alias("embedding"))
    cells = lines.unionByName(blank).select(
        block_of(F.col("k"), GRAY_SIDE).alias("image_id"),
        F.pmod(F.col("k"), F.lit(GRAY_SIDE)).alias("y"),
        F.posexplode("embedding").alias("x", "e"),
    )
    value = F.coalesce(
        clamp8(F.floor(F.lit(128.0) + F.lit(220.0) * F.col("e").cast("double"))),
        F.lit(0),
    )
    return as_pixels(
        cells.select(
            "image_id",
            F.lit(GRAY_SIDE).alias("width"),
            F.lit(GRAY_SIDE).alias("height"),
            "y",
            "x",
            F.lit(None).cast("int").alias("a"),
            value.alias("r"),
            value.alias("g"),
            value.alias("b"),
        )
    )


def rgb_from_orders(
    spark: SparkSession, folder: str, alpha: bool = False, wide: bool = False
) -> DataFrame:
    """An order is a pixel; 1024 consecutive order keys make a 32 x 32 image."""
    table = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )
    if wide:
        table = widen(table, "o_orderkey")
    key = F.col("o_orderkey")
    real = table.where(key.isNotNull()).select(
        key.alias("k"),
        ((key * 36) % 256).alias("a"),
        (F.floor("o_totalprice").cast("bigint") % 256).alias("r"),
        (F.col("o_custkey") % 256).alias("g"),
        ((F.col("o_custkey") * 7 + key) % 256).alias("b"),
    )
    zero = F.lit(0).cast("bigint")
    blank = missing_keys(table, "o_orderkey", RGB_CELLS).select(
        "k", *[zero.alias(c) for c in "argb"]
    )
    placed = real.unionByName(blank)
    if not alpha:
        placed = placed.withColumn("a", F.lit(None).cast("int"))
    return as_pixels(_place_cells(placed, block_of(F.col("k"), RGB_CELLS), F.col("k")))


def _place_cells(df: DataFrame, image: Column, key: Column) -> DataFrame:
    cell = F.pmod(key, F.lit(RGB_CELLS))
    return df.select(
        image.alias("image_id"),
        F.lit(RGB_SIDE).alias("width"),
        F.lit(RGB_SIDE).alias("height"),
        idiv(cell, RGB_SIDE).alias("y"),
        (cell % RGB_SIDE).alias("x"),
        "a",
        "r",
        "g",
        "b",
    )


def prefix_offsets(
    counts: DataFrame, key: str, bucket: str, fan: int = 4096
) -> DataFrame:
    """Exclusive prefix sum of ``n`` per key over ordered buckets.

    Two levels: buckets are summed into super-buckets of ``fan`` buckets, those
    are accumulated, then buckets inside each. No window group exceeds ``fan``
    rows on the lower level, whatever share of the data one key holds.
    Returns key, bucket, n, start.
    """
    fine = counts.withColumn("_sup", idiv(F.col(bucket), fan))
    before = lambda *by, order: (
        Window.partitionBy(*by)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    coarse = fine.groupBy(key, "_sup").agg(F.sum("n").alias("_sn"))
    coarse = coarse.select(
        key,
        "_sup",
        F.coalesce(F.sum("_sn").over(before(key, order="_sup")), F.lit(0)).alias("_base"),
    )
    inside = fine.withColumn(
        "_in",
        F.coalesce(F.sum("n").over(before(key, "_sup", order=bucket)), F.lit(0)),
    )
    return inside.join(coarse, [key, "_sup"]).select(
        key, bucket, "n", (F.col("_base") + F.col("_in")).alias("start")
    )


# A prime modulus and one multiplier per ordering column.
MIX_MODULUS = 2147483647
MIX = {"l_orderkey": 7919, "l_linenumber": 104729, "l_partkey": 1299709}


def _mixed(columns: dict[str, int]) -> Column:
    """Evenly spread number below MIX_MODULUS; products stay below 2^62."""
    total = F.lit(0).cast("bigint")
    for name, k in columns.items():
        total = total + F.col(name).cast("bigint") * k
    first = F.pmod(total, F.lit(MIX_MODULUS))
    inner = (first * 48271 + 11) % MIX_MODULUS
    return (first * inner + inner) % MIX_MODULUS


def rgb_from_lineitem(
    spark: SparkSession, folder: str, rows_per_bucket: int = 65_536
) -> DataFrame:
    """A line item is a pixel of its supplier's rasters, in a scattered order.

    The order is by a mixed number of the key columns, then by the columns. The
    rank of a line inside its supplier is (lines in earlier buckets of that
    number) + (rank inside the bucket). Buckets are so many that even a
    supplier, or an order, with most of all lines has about ``rows_per_bucket``
    in each; no window sees more. A supplier fills as many 32 x 32 images as it
    needs; image_id = supplier * 2^32 + page.
    """
    table = read_table(spark, folder, "lineitem")
    buckets = table.count() // rows_per_bucket + 1  # from Parquet row counts
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    lines = table.select("l_suppkey", *keys, "l_quantity", _mixed(MIX).alias("mix")).withColumn(
        "bucket", idiv(F.col("mix"), MIX_MODULUS // buckets + 1)
    )
    counts = lines.groupBy("l_suppkey", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = prefix_offsets(counts, "l_suppkey", "bucket")
    in_bucket = Window.partitionBy("l_suppkey", "bucket").orderBy("mix", *keys)
    ranked = lines.withColumn("rn", F.row_number().over(in_bucket) - 1).join(
        offsets.select("l_suppkey", "bucket", "start"), ["l_suppkey", "bucket"]
    )
    real = ranked.select(
        "l_suppkey",
        (F.col("start") + F.col("rn")).alias("k"),
        ((F.col("l_linenumber") * 36) % 256).alias("a"),
        (F.floor(F.col("l_quantity") * 5).cast("bigint") % 256).alias("r"),
        (F.floor("l_extendedprice").cast("bigint") % 256).alias("g"),
        (F.col("l_partkey") % 256).alias("b"),
    )
    totals = counts.groupBy("l_suppkey").agg(F.sum("n").alias("n"))
    end = idiv(F.col("n") + (RGB_CELLS - 1), RGB_CELLS) * RGB_CELLS
    blank = totals.select(
        "l_suppkey", F.explode(span(F.col("n"), end)).alias("k")
    ).select("l_suppkey", "k", *[F.lit(0).alias(c) for c in "argb"])
    image = F.shiftleft(F.col("l_suppkey"), 32) + idiv(F.col("k"), RGB_CELLS)
    return as_pixels(_place_cells(real.unionByName(blank), image, F.col("k")))


def bytes_from_documents(
    spark: SparkSession, folder: str, width: int = BYTE_WIDTH
) -> DataFrame:
    """Byte plot: the UTF-8 bytes of a document, ``width`` to a scan line.

    A null or empty text has no byte, so its plot has no line and no row; ``unplotted`` lists them.
    """
    table = widen(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return byte_plot(table, "doc_id", "text", width)


def unplotted(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = BYTE_WIDTH) -> DataFrame:
    """The images without a line: image_id, width and height 0 of null and empty texts."""
    empty = df.where(F.coalesce(F.length(text), F.lit(0)) == 0)
    return empty.select(F.col(key).alias("image_id"), F.lit(width).alias("width"), F.lit(0).alias("height"))


def byte_plot(df: DataFrame, key: str, text: str, width: int = BYTE_WIDTH) -> DataFrame:
    raw = df.select(
        F.col(key).alias("image_id"), F.encode(F.col(text), "UTF-8").alias("raw")
    ).withColumn("height", idiv(F.octet_length("raw") + (width - 1), width).cast("int"))
    line = F.substring(F.col("raw"), F.col("y") * width + 1, F.lit(width))
    lines = raw.select(
        "image_id", "height", "raw", F.explode(span(F.lit(0), F.col("height"))).alias("y")
    ).select("image_id", "height", "y", F.decode(line, "ISO-8859-1").alias("line"))
    # One Latin-1 character per byte; past the end of the text ascii('') is 0.
    cells = lines.select(
        "image_id",
        "height",
        "y",
        "line",
        F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"),
    )
    value = F.ascii(F.substring(F.col("line"), F.col("x") + 1, F.lit(1)))
    return as_pixels(
        cells.select(
            "image_id",
            F.lit(width).alias("width"),
            "height",
            "y",
            "x",
            F.lit(None).cast("int").alias("a"),
            value.alias("r"),
            value.alias("g"),
            value.alias("b"),
        )
    )


def image_bound(spark: SparkSession, folder: str, table: str, per_image: int) -> int:
    """Bound on the images of a binding: as many as rows, or as its keys span.

    The span comes from the extremes of the key, so gaps cannot hide images.
    """
    key = {"orders": "o_orderkey", "embeddings": "vec_id", "documents": "doc_id"}[table]
    rows, low, high = read_table(spark, folder, table).agg(F.count(key), F.min(key), F.max(key)).first()
    return min(rows, high // per_image - low // per_image + 1) if rows else 0
