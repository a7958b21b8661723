"""Keyed watermarks in the lowest bits of the samples.

The stream of a frame is: two cookie bytes, a status byte, the file name, a
zero byte, a 32-bit length and the payload, most significant bit first. Bit n
goes to sample (n mod row) of line (n div row) after three keyed rotations:
the line by a hash of the column, the column by a hash of the line, the line
again. Each rotation can be undone, so the map is a bijection: no two bits
meet, and extraction finds the bit number of a sample by running it backwards.

Hashes are needed only per column and per line, so they are kept as two arrays
per image and neither direction hashes anything per pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..layout import MAX_SIDE, attach, heads, idiv, require, shuffled, span

# The leading bytes of a stream.
COOKIE = "4DA0"
STATUS = "00"
OVERHEAD_BYTES = 8
BYTES_PER_CHUNK = 512
HASH_BYTES = 4 * 4 * MAX_SIDE  # a hash per sample of the longest line


def _samples(channels: str) -> list[str]:
    require(channels in ("rgb", "argb", "gray"), "channels are rgb, argb or gray")
    return ["r"] if channels == "gray" else list(channels)


def frame_keys(df: DataFrame, passphrase: str, channels: str) -> DataFrame:
    """(image_id, width, height, key): digest of the upper seven bits.

    Digests are taken per scan line and then over the line digests in order;
    both groups are bounded by the image side.
    """
    parts = [
        F.lpad(F.hex(F.col(c).bitwiseAND(F.lit(254))), 2, "0") for c in _samples(channels)
    ]
    cell = F.struct("x", F.concat(*parts).alias("s"))
    text = lambda rows, field: F.array_join(F.transform(rows, lambda r: r[field]), "")
    lines = df.groupBy("image_id", "width", "height", "y").agg(
        F.sha2(text(F.sort_array(F.collect_list(cell)), "s"), 256).alias("digest")
    )
    frames = lines.groupBy("image_id", "width", "height").agg(
        F.sort_array(F.collect_list(F.struct("y", "digest"))).alias("lines")
    )
    whole = F.sha2(text(F.col("lines"), "digest"), 256)
    phrase = F.lit(passphrase)
    return frames.select(
        "image_id", "width", "height", F.sha1(F.concat(phrase, whole, phrase)).alias("key")
    )


def _hashes(size: Column) -> Column:
    """Hash of each number below ``size`` under the frame's key."""

    def one(i: Column) -> Column:
        word = F.substring(F.sha1(F.concat(F.col("key"), F.lit(":"), i.cast("string"))), 1, 8)
        return F.conv(word, 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    return F.transform(F.sequence(F.lit(0), size - 1), one)


def rotations(df: DataFrame, passphrase: str, channels: str) -> DataFrame:
    """One row per image: samples per row and the hash array of both axes."""
    per_row = (F.col("width") * len(_samples(channels))).alias("per_row")
    keys = frame_keys(df, passphrase, channels).select("image_id", "height", "key", per_row)
    return keys.select(
        "image_id",
        F.col("height").alias("lines"),
        "per_row",
        _hashes(F.greatest("per_row", "height")).alias("hash"),
    )


def _hash(at: Column) -> Column:
    return F.get("hash", at.cast("int"))


def _position(n: Column) -> tuple[Column, Column]:
    """(line, sample in the line) of bit n."""
    x0, y0 = n % F.col("per_row"), idiv(n, F.col("per_row"))
    y1 = (y0 + _hash(x0)) % F.col("lines")
    x1 = (x0 + _hash(y1)) % F.col("per_row")
    return (y1 + _hash(x1)) % F.col("lines"), x1


def _bit_number(y: Column, sample: Column) -> Column:
    """Inverse of ``_position``."""
    y1 = F.pmod(y - _hash(sample), F.col("lines"))
    x0 = F.pmod(sample - _hash(y1), F.col("per_row"))
    y0 = F.pmod(y1 - _hash(x0), F.col("lines"))
    return y0.cast("bigint") * F.col("per_row") + x0


def byte_stream(name: Column, payload: Column) -> Column:
    size = F.lpad(F.hex(F.octet_length(payload)), 8, "0")
    return F.concat(
        F.unhex(F.lit(COOKIE + STATUS)), F.encode(name, "UTF-8"), F.unhex(F.lit("00")), F.unhex(size), payload
    )


def fits(df: DataFrame, payloads: DataFrame, channels: str) -> DataFrame:
    """Payload rows with ``fits``: the stream must be shorter than an eighth of the samples."""
    cover = F.col("width").cast("bigint") * F.col("height") * len(_samples(channels))
    size = F.octet_length("payload") + F.octet_length(F.encode("name", "UTF-8")) + OVERHEAD_BYTES
    sized = payloads.join(heads(df).select("image_id", "width", "height"), "image_id")
    return sized.withColumn("fits", size < idiv(cover, 8)).drop("width", "height")


def embed(
    df: DataFrame,
    payloads: DataFrame,
    passphrase: str,
    channels: str = "rgb",
    rows: int | None = None,
    refused: str = "raise",
) -> DataFrame:
    """Write (image_id, name, payload) into the frames.

    A payload that does not fit is an error; with ``refused="skip"`` its frame
    stays as it is, and ``fits`` tells which those are.

    Long payloads are cut into chunks that are dealt over tasks before bits are
    made; the bits meet the pixels in an equi join on their coordinates.
    """
    require(refused in ("raise", "skip"), "refused is raise or skip")
    names = _samples(channels)
    keys = rotations(df, passphrase, channels)
    judged = fits(df, payloads, channels)
    stream = byte_stream(F.col("name"), F.col("payload"))
    if refused == "raise":
        text = F.concat(F.lit("payload too long for image "), F.col("image_id").cast("string"))
        stream = F.when(F.col("fits"), stream).otherwise(F.raise_error(text).cast("binary"))
    else:
        judged = judged.where("fits")
    streams = judged.select("image_id", stream.alias("stream"))
    chunks = streams.select(
        "image_id",
        F.posexplode(
            F.transform(
                span(F.lit(0), idiv(F.octet_length("stream") + (BYTES_PER_CHUNK - 1), BYTES_PER_CHUNK)),
                lambda i: F.substring(
                    F.col("stream"), (i * BYTES_PER_CHUNK + 1).cast("int"), F.lit(BYTES_PER_CHUNK)
                ),
            )
        ).alias("chunk", "part"),
    )
    keyed = attach(chunks, keys, rows=rows, slot=F.col("chunk"), row_bytes=HASH_BYTES)
    bits = keyed.withColumn("i", F.explode(span(F.lit(0), F.octet_length("part") * 8)))
    byte = F.conv(F.hex(F.substring(F.col("part"), idiv(F.col("i"), 8).cast("int") + 1, F.lit(1))), 16, 10)
    shift = 7 - F.col("i") % 8
    n = F.col("chunk").cast("bigint") * (BYTES_PER_CHUNK * 8) + F.col("i")
    y, sample = _position(n)
    placed = bits.select(
        "image_id",
        y.cast("int").alias("y"),
        idiv(sample, len(names)).cast("int").alias("x"),
        (sample % len(names)).alias("ch"),
        F.call_function("shiftright", byte.cast("int"), shift).bitwiseAND(F.lit(1)).alias("bit"),
    )
    marks = placed.groupBy("image_id", "y", "x").agg(
        *[F.max(F.when(F.col("ch") == i, F.col("bit"))).alias(f"_m{c}") for i, c in enumerate(names)]
    )
    joined = df.join(shuffled(marks), ["image_id", "y", "x"], "left")
    new = {
        c: F.coalesce(F.col(c).bitwiseAND(F.lit(254)).bitwiseOR(F.col(f"_m{c}")), F.col(c))
        for c in names
    }
    if channels == "gray":
        new["g"] = new["b"] = new["r"]
    return joined.withColumns(new).select(*df.columns)


def read_bytes(
    df: DataFrame, passphrase: str, channels: str = "rgb", rows: int | None = None
) -> DataFrame:
    """All whole bytes of the lowest bits in stream order: (image_id, pos, byte)."""
    names = _samples(channels)
    keyed = attach(df, rotations(df, passphrase, channels), rows=rows, row_bytes=HASH_BYTES)
    samples = F.explode(
        F.array(
            *[F.struct(F.lit(i).alias("ch"), F.col(c).bitwiseAND(F.lit(1)).alias("bit")) for i, c in enumerate(names)]
        )
    )
    number = _bit_number(F.col("y"), F.col("x") * len(names) + F.col("s.ch"))
    bits = keyed.withColumn("s", samples).select("image_id", number.alias("n"), "s.bit")
    whole = F.call_function("shiftleft", F.col("bit"), (7 - F.col("n") % 8).cast("int"))
    return (
        bits.groupBy("image_id", idiv(F.col("n"), 8).alias("pos"))
        .agg(F.sum(whole).cast("int").alias("byte"), F.count(F.lit(1)).alias("_k"))
        .where("_k = 8")
        .drop("_k")
    )


def extract(
    df: DataFrame, passphrase: str, channels: str = "rgb", rows: int | None = None
) -> DataFrame:
    """Payload bytes of marked frames: (image_id, name, length, i, byte).

    The header is found by aggregation: the first zero byte after the status
    ends the name. A wrong key yields no cookie and so no rows.
    """
    stream = read_bytes(df, passphrase, channels, rows)
    at = lambda pos: F.max(F.when(F.col("pos") == pos, F.col("byte")))
    first, second = (int(COOKIE[i : i + 2], 16) for i in (0, 2))
    ends = (
        stream.where("pos < 2 OR (pos >= 3 AND byte = 0)")
        .groupBy("image_id")
        .agg(
            at(0).alias("c0"),
            at(1).alias("c1"),
            F.min(F.when(F.col("pos") >= 3, F.col("pos"))).alias("stop"),
        )
        .where((F.col("c0") == first) & (F.col("c1") == second))
        .select("image_id", "stop")
    )
    size = F.when(
        F.col("pos").between(F.col("stop") + 1, F.col("stop") + 4),
        F.col("byte") * F.pow(F.lit(256), F.col("stop") + 4 - F.col("pos")).cast("bigint"),
    )
    letter = F.when(
        (F.col("pos") >= 3) & (F.col("pos") < F.col("stop")),
        F.struct("pos", F.lpad(F.hex("byte"), 2, "0").alias("h")),
    )
    # only the file name of a marked frame is collected
    header = (
        attach(stream, ends, rows=rows, slot=F.col("pos"))
        .where(F.col("pos") <= F.col("stop") + 4)
        .groupBy("image_id")
        .agg(
            F.max("stop").alias("stop"),
            F.sum(size).alias("length"),
            F.sort_array(F.collect_list(letter)).alias("letters"),
        )
        .select(
            "image_id",
            "stop",
            "length",
            F.decode(
                F.unhex(F.array_join(F.transform("letters", lambda e: e["h"]), "")), "UTF-8"
            ).alias("name"),
        )
    )
    body = attach(stream, header, rows=rows, slot=F.col("pos"))
    begin = F.col("stop") + 5
    return body.where((F.col("pos") >= begin) & (F.col("pos") < begin + F.col("length"))).select(
        "image_id", "name", "length", (F.col("pos") - begin).alias("i"), "byte"
    )


def assemble(found: DataFrame) -> DataFrame:
    """Whole payloads as BINARY; one value per frame, an eighth of its samples at most."""
    # bytes become pieces of BYTES_PER_CHUNK first: few long values are gathered, not many short
    letter = F.struct("i", F.lpad(F.hex("byte"), 2, "0").alias("h"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda e: e["h"]), "")
    parts = found.groupBy("image_id", "name", "length", idiv(F.col("i"), BYTES_PER_CHUNK).alias("part")).agg(
        text(letter).alias("h")
    )
    gathered = parts.groupBy("image_id", "name", "length").agg(
        F.sort_array(F.collect_list(F.struct("part", "h"))).alias("pieces")
    )
    return gathered.select(
        "image_id",
        "name",
        F.unhex(F.array_join(F.transform("pieces", lambda e: e["h"]), "")).alias("payload"),
    )
