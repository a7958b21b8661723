"""Scan lines as bytes: the layout in which neighbourhoods are shuffled.

``packed`` turns pixels into fragments of scan lines, one BINARY of r, g, b samples
(and one of alpha) per run of neighbouring pixels, so that a shuffle and Python move a
few bytes a pixel. ``unpacked`` turns lines of samples into pixels again, in the JVM.
``banded`` deals fragments into bands of whole lines with a halo and runs a NumPy
function on every band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..layout import PIXEL_COLUMNS, shuffled, span
from ..session import fresh_path

LINE = 14  # bits of an x coordinate
Y_BITS = 20  # bits of a y coordinate
FRAGMENT = "image_id bigint, width int, height int, y int, x int, n int, rgb binary, alpha binary"
LINES = FRAGMENT.replace("n int, ", "")
PACK_PIXELS = 1 << 17  # pixels packed at once
BAND_PIXELS = 1 << 19  # a band has about so many pixels besides its halo

# view: rows x columns x channels of a band with its halo; top: first row of the band
# inside the view; rows: how many it has.
BandFunction = Callable[[np.ndarray, int, int], np.ndarray]
RowFunction = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """BINARY values that lie in a row; ends: where each begins, and the end."""
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def borders(column: pa.Array) -> np.ndarray:
    """Where the values of a BINARY column begin, and the end."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def flat(column: pa.Array) -> np.ndarray:
    """The bytes of a BINARY column in a row."""
    ends = borders(column)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)


def fragments(df: DataFrame) -> DataFrame:
    """Fragments of scan lines: image, size, y, first x, pixels, samples; alpha is two bytes
    a pixel, -1 for none, or NULL if no pixel of the fragment has one. A fragment of grays
    has one byte a pixel, others three.

    Pixels go to Python as three numbers each and are packed where they are read, so no
    pixel is shuffled. What comes in the order of lines gives a fragment a line; other
    input is sorted by PACK_PIXELS first, and a line is then in several fragments.
    """
    parts = {"x": 33, "a": 24, "r": 16, "g": 8, "b": 0}  # lowest bit of each field
    values = {"a": F.coalesce("a", F.lit(256))}
    code = F.lit(0).cast("bigint")
    for name, bit in parts.items():
        code = code.bitwiseOR(F.shiftleft(values.get(name, F.col(name)).cast("bigint"), bit))
    line = F.shiftleft(F.col("height").cast("bigint"), LINE + Y_BITS).bitwiseOR(
        F.shiftleft(F.col("y").cast("bigint"), LINE)).bitwiseOR(F.col("width").cast("bigint"))
    small = df.select(F.col("image_id").cast("bigint").alias("image_id"), line.alias("line"), code.alias("code"))

    def pack(rows: pa.RecordBatch) -> pa.RecordBatch:
        lost = rows.column(0).is_null().to_numpy(zero_copy_only=False)
        image = rows.column(0).fill_null(0).to_numpy()
        line, code = rows.column(1).to_numpy(), rows.column(2).to_numpy()

        def cuts() -> np.ndarray:
            new = (np.diff(image) != 0) | (np.diff(line) != 0) | (np.diff(code >> 33) != 1) | (lost[1:] != lost[:-1])
            return np.flatnonzero(np.append(True, new))

        at = cuts()
        if len(at) * 16 > len(code):
            order = np.lexsort((code >> 33, line, image, lost))
            image, line, code, lost = image[order], line[order], code[order], lost[order]
            at = cuts()
        ends = np.append(at, len(code))
        samples = code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 5:]
        gray = np.minimum.reduceat((samples[:, :1] == samples[:, 1:]).all(axis=1), at)
        if gray.all():
            rgb = binary(samples[:, 0], ends)
        else:
            each = np.repeat(np.where(gray, 1, 3), np.diff(ends))
            kept = np.arange(3) < each[:, None]
            rgb = binary(samples[kept], np.append(0, np.cumsum(each))[ends])
        alpha = (code >> 24 & 511).astype(np.int16)
        alpha[alpha == 256] = -1
        some = np.maximum.reduceat(alpha, at) >= 0
        alphas = pa.nulls(len(at), pa.binary())
        if some.any():
            alphas = binary(alpha.view(np.uint8), ends * 2).take(pa.array(np.arange(len(at)), mask=~some))
        where = line[at]
        width, y, height = where & (1 << LINE) - 1, where >> LINE & (1 << Y_BITS) - 1, where >> LINE + Y_BITS
        numbers = [pa.array(c.astype(np.int32)) for c in (width, height, y, code[at] >> 33, np.diff(ends))]
        return pa.RecordBatch.from_arrays(
            [pa.array(image[at], mask=lost[at]), *numbers, rgb, alphas],
            ["image_id", "width", "height", "y", "x", "n", "rgb", "alpha"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += part.num_rows
            if size >= PACK_PIXELS:
                yield pack(pa.concat_batches(held))
                held, size = [], 0
        if size:
            yield pack(pa.concat_batches(held))

    return small.where("code is not null").mapInArrow(run, FRAGMENT)


def samples(rgb: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Pixels x channels of fragments with so many pixels: one channel if all are gray."""
    data, each = flat(rgb), np.diff(borders(rgb))
    if (each == sizes).all():
        return data[:, None]
    if (each == 3 * sizes).all():
        return data.reshape(-1, 3)
    wide = np.repeat(each // np.maximum(sizes, 1), sizes)  # bytes of each pixel
    first = np.cumsum(wide) - wide
    return data[first[:, None] + np.where(wide[:, None] == 3, np.arange(3), 0)]


def packed(df: DataFrame) -> DataFrame:
    """Fragments joined to whole lines, three bytes a pixel; a line with gaps gives several."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fragments(df).repartition(parts, "image_id", "y").sortWithinPartitions("image_id", "y", "x")

    def borders_of(rows: pa.RecordBatch) -> np.ndarray:
        """Whether a row is of another line than the row before it."""
        lost = rows.column(0).is_null().to_numpy(zero_copy_only=False)
        new = lost[1:] != lost[:-1]
        for c in rows.columns[:4]:
            new |= np.diff(c.fill_null(0).to_numpy()) != 0
        return new

    def joined(rows: pa.RecordBatch) -> pa.RecordBatch:
        x, sizes = (rows.column(i).to_numpy() for i in (4, 5))
        data = samples(rows.column(6), sizes)
        data = np.repeat(data, 3, axis=1) if data.shape[1] == 1 else data
        alpha = np.full(len(data), -1, np.int16)
        some = rows.column(7).is_valid().to_numpy(zero_copy_only=False)
        alpha[np.repeat(some, sizes)] = np.frombuffer(flat(rows.column(7)).tobytes(), np.int16)
        at = np.flatnonzero(np.append(True, borders_of(rows) | (x[1:] != (x + sizes)[:-1])))
        ends = np.append(0, np.cumsum(sizes))[np.append(at, len(x))]
        none = ~np.logical_or.reduceat(some, at)
        alphas = binary(alpha.view(np.uint8), ends * 2).take(pa.array(np.arange(len(at)), mask=none))
        return pa.RecordBatch.from_arrays(
            [*(rows.column(i).take(pa.array(at)) for i in range(5)), binary(data, ends * 3), alphas],
            ["image_id", "width", "height", "y", "x", "rgb", "alpha"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            whole = pa.concat_batches([*waiting, part])
            last = np.flatnonzero(borders_of(whole))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield joined(whole.slice(0, cut))
            waiting = [whole.slice(cut)]
        if waiting:
            yield joined(waiting[0])

    return dealt.mapInArrow(run, LINES)


def unpacked(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of lines with `colors` (array of 24-bit numbers) and `alphas` (array, or NULL)."""
    cells = lines.select(*extra, "image_id", "width", "height", "y", "x", "alphas", F.posexplode("colors").alias("i", "v"))
    alpha = F.get("alphas", F.col("i")).cast("int")
    values = {
        "x": F.col("x") + F.col("i"), "a": F.when(alpha >= 0, alpha),
        "r": F.shiftright("v", 16), "g": F.shiftright("v", 8).bitwiseAND(F.lit(255)), "b": F.col("v").bitwiseAND(F.lit(255)),
    }
    return cells.select(*extra, *[values.get(c, F.col(c)).alias(c) for c in PIXEL_COLUMNS])


def band_rows(width: Column, rows: int | None) -> Column:
    """Lines of a band: about BAND_PIXELS pixels, 64 lines at least."""
    return F.lit(rows) if rows else F.greatest(F.lit(64), F.expr(f"{BAND_PIXELS} div width").cast("int"))


def banded(
    df: DataFrame, radius: int, fn: BandFunction, rows: int | None = None,
    names: list[str] | None = None, separate: bool = True, uneven: RowFunction | None = None,
) -> DataFrame:
    """Run a neighbourhood function on bands of whole lines with a halo of `radius` lines.

    A line goes to its own band and to those whose halo holds it. A band has a bounded
    number of pixels whatever the size of its image, and the rows shuffled are about
    the lines, each once or, at a border, twice. Every pixel given comes out once; one
    that is missing in an image counts as black. With ``names`` the function gives one
    result per name, told apart by ``kernel``. ``separate``: channels don't mix, so that
    bands whose channels are equal need one. ``uneven`` takes over where pixels are
    missing or given twice: it gets their y, x and samples, and gives a row for each.
    """
    size = band_rows(F.col("width"), rows)
    lo = F.greatest(F.lit(0), F.floor((F.col("y") - radius) / size))
    hi = F.least(F.floor((F.col("height") - 1) / size), F.floor((F.col("y") + radius) / size))
    dealt = fragments(df).withColumn("size", size).withColumn("band", F.explode(span(lo.cast("int"), hi.cast("int") + 1)))
    # a number given keeps small bytes, which become many pixels, from being dealt to few tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "image_id", "band").sortWithinPartitions("image_id", "band", "y", "x")

    def one(own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The fragments of a band with their new samples."""
        image, width, height, ys, xs, ns, rgb, alpha, step, band = own.columns
        y, wide = ys.to_numpy(), width[0].as_py()
        sizes = ns.to_numpy()
        low, data = int(y[0]), samples(rgb, sizes)
        if not separate and data.shape[1] == 1:
            data = np.repeat(data, 3, axis=1)
        first = (y - low).astype(np.int64) * wide + xs.to_numpy()
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
        view = np.zeros(((int(y[-1]) - low + 1) * wide, data.shape[1]), np.uint8)
        view[at] = data
        core = np.flatnonzero(y // step[0].as_py() == band[0].as_py())
        if not len(core):
            return
        begin, top = int(core[0]), int(y[core[0]]) - low
        if separate and (data[:, :1] == data[:, 1:]).all():
            view = view[:, :1]
        ends, skipped = np.append(0, np.cumsum(sizes[core])), int(sizes[:begin].sum())
        if uneven and (len(at) != len(view) or np.bincount(at).max() > 1):
            out = uneven(at // wide, at % wide, data)
            inside = np.arange(skipped, skipped + int(ends[-1]))
        else:
            out = fn(view.reshape(-1, wide, view.shape[1]), top, int(y[core[-1]]) - low - top + 1)
            inside = at[skipped:][: int(ends[-1])] - top * wide
        kept = [c.slice(begin, len(core)) for c in (image, width, height, ys, xs, alpha)]
        alphas = pa.nulls(len(core), pa.list_(pa.int16()))
        if kept[-1].null_count < len(core):
            alphas = pa.array([None if v is None else np.frombuffer(v, np.int16) for v in kept[-1].to_pylist()], alphas.type)
        for name, plane in zip(names or [None], out if names else [out]):
            new = plane.reshape(-1, plane.shape[-1])[inside].astype(np.int32)
            codes = new @ np.array([65536, 256, 1], np.int32) if new.shape[1] == 3 else new[:, 0] * 0x10101
            colors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes))
            head = [] if name is None else [pa.array([name] * len(core))]
            yield pa.RecordBatch.from_arrays([*head, *kept[:-1], colors, alphas], out_names)

    out_names = [*(["kernel"] if names else []), "image_id", "width", "height", "y", "x", "colors", "alphas"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for part in parts:
            if not part.num_rows:
                continue
            whole = pa.concat_batches([*waiting, part])
            lost = whole.column(0).is_null().to_numpy(zero_copy_only=False)
            image, band = whole.column(0).fill_null(0).to_numpy(), whole.column(9).to_numpy()
            border = np.flatnonzero((image[1:] != image[:-1]) | (band[1:] != band[:-1]) | (lost[1:] != lost[:-1])) + 1
            starts = np.append(0, border)
            for a, b in zip(starts, border):
                yield from one(whole.slice(int(a), int(b - a)))
            waiting = [whole.slice(int(starts[-1]))]
        if waiting:
            yield from one(waiting[0])

    head = "kernel string, " if names else ""
    lines = dealt.mapInArrow(
        run, f"{head}image_id bigint, width int, height int, y int, x int, colors array<int>, alphas array<smallint>")
    return unpacked(lines, ("kernel",) if names else ())


SLOT_LINES = 512  # lines of an image that meet one copy of its curves


def equalised(df: DataFrame) -> DataFrame | None:
    """Every colour as 255 * cum(v) div N of its image; None if a pixel lacks a sample.

    The fragments of lines are written once. Their histograms, at most 256 rows an image
    and PACK_PIXELS, give the curves; lines meet the curves of their image, copied once
    per SLOT_LINES lines, so no pixel is shuffled.
    """
    spark, seen = df.sparkSession, Observation()
    lacking = F.count(F.when(F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull(), 1))
    path = fresh_path(spark)
    fragments(df.observe(seen, lacking.alias("n"))).write.parquet(path)
    if seen.get["n"]:
        return None
    lines = spark.read.schema(FRAGMENT).parquet(path)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            image, sizes = part.column(0), part.column(2).to_numpy()
            keys = image.dictionary_encode(null_encoding="encode")
            code = keys.indices.to_numpy()
            data, of = samples(part.column(3), sizes), np.repeat(code, sizes)
            deep = np.zeros(len(keys.dictionary), np.int32)
            np.maximum.at(deep, code, part.column(1).to_numpy())
            tally = [np.bincount(of * 256 + data[:, min(c, data.shape[1] - 1)], minlength=256 * len(deep)) for c in range(3)]
            at = np.flatnonzero(sum(tally))
            yield pa.RecordBatch.from_arrays(
                [keys.dictionary.take(pa.array(at // 256)), pa.array(deep[at // 256]), pa.array((at % 256).astype(np.int32)),
                 *(pa.array(t[at]) for t in tally)], ["image_id", "y", "value", "r", "g", "b"])

    def curves(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, image, deep = np.zeros((3, 256), np.int64), None, -1

        def ready() -> pa.RecordBatch:
            curve = held.cumsum(axis=1) * 255 // held.sum(axis=1)[:, None]
            if image is None:  # belongs to no image and stays
                curve = np.tile(np.arange(256), (3, 1))
            curve = curve.astype(np.uint8)
            n = deep // SLOT_LINES + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([image] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([curve.tobytes()] * n)],
                ["image_id", "slot", "curve"])

        for part in parts:
            if not part.num_rows:
                continue
            images, ys, v = part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()
            tally = np.stack([part.column(3 + c).to_numpy() for c in range(3)])
            cuts = [0, *(i for i in range(1, len(images)) if images[i] != images[i - 1]), len(images)]
            for a, b in zip(cuts, cuts[1:]):
                if deep >= 0 and images[a] != image:
                    yield ready()
                    held, deep = np.zeros((3, 256), np.int64), -1
                image, deep = images[a], max(deep, int(ys[a:b].max()))
                for c in range(3):
                    np.add.at(held[c], v[a:b], tally[c, a:b])
        if deep >= 0:
            yield ready()

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            sizes = part.column(5).to_numpy()
            data, of = samples(part.column(6), sizes), np.repeat(np.arange(len(sizes)), sizes)
            curve = flat(part.column(8)).reshape(-1, 3, 256)
            code = np.zeros(len(of), np.int32)
            for c in range(3):
                code = code << 8 | curve[of, c, data[:, min(c, data.shape[1] - 1)]]
            alphas = pa.nulls(len(sizes), pa.list_(pa.int16()))
            if part.column(7).null_count < len(sizes):
                alphas = pa.array([None if v is None else np.frombuffer(v, np.int16) for v in part.column(7).to_pylist()], alphas.type)
            colors = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(code))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], colors, alphas], ["image_id", "width", "height", "y", "x", "colors", "alphas"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tallies = lines.select("image_id", "y", "n", "rgb").mapInArrow(
        count, "image_id bigint, y int, value int, r bigint, g bigint, b bigint")
    found = tallies.repartition(n, "image_id").sortWithinPartitions("image_id").mapInArrow(
        curves, "image_id bigint, slot int, curve binary")
    key, slot = F.col("lines.image_id").eqNullSafe(F.col("found.image_id")), (F.col("y") / SLOT_LINES).cast("int")
    met = lines.alias("lines").join(shuffled(found).alias("found"), key & (slot == F.col("found.slot")))
    return unpacked(met.select("lines.*", "curve").mapInArrow(
        apply, "image_id bigint, width int, height int, y int, x int, colors array<int>, alphas array<smallint>"))
