"""Image files as a sink: a data source writer with one commit for the whole folder.

A task streams the scan lines of its images into PNG files of a staging folder beside the
target. The commit removes what lost or repeated attempts left there and gives the folder
its name, so a failed job leaves nothing at the target.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..layout import require
from ..operators import lines

CHUNK_BYTES = 1 << 16  # of compressed samples written at once


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is a local one."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would take for it."""
    if ":" in path.split("/")[0]:
        return path.rstrip("/")
    root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return root.rstrip("/") + path.rstrip("/") if path.startswith("/") else path.rstrip("/")


def exists(path: str) -> bool:
    system, at = storage(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def staged(path: str) -> str:
    """A folder name beside the path."""
    return f"{path}-staging-{uuid.uuid4().hex}"


def settle(stage: str, path: str, overwrite: bool) -> None:
    """The staging folder becomes the path; what was there goes only now."""
    system, source = storage(stage)
    target = storage(path)[1]
    if overwrite and exists(path):
        system.delete_dir(target)
    system.move(source, target)


def discard(stage: str) -> None:
    if exists(stage):
        system, at = storage(stage)
        system.delete_dir(at)


class PngStream:
    """One image, line by line; needs memory for a line and a chunk."""

    def __init__(self, out, width: int, height: int, alpha: bool):
        self.out, self.packer, self.held = out, zlib.compressobj(6), bytearray()
        out.write(b"\x89PNG\r\n\x1a\n")
        self.chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0))

    def chunk(self, kind: bytes, body: bytes) -> None:
        self.out.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)))

    def line(self, samples: bytes) -> None:
        self.held += self.packer.compress(b"\0" + samples)
        if len(self.held) >= CHUNK_BYTES:
            self.chunk(b"IDAT", bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.chunk(b"IDAT", bytes(self.held) + self.packer.flush())
        self.chunk(b"IEND", b"")
        self.out.close()


def samples(rgb: bytes, alpha: bytes | None, wanted: bool) -> bytes:
    """Interleaved samples of a line; files hold opacity, pixels hold transparency."""
    see_through = np.full(len(rgb) // 3, -1, np.int16) if alpha is None else np.frombuffer(alpha, np.int16)
    if not wanted:
        if (see_through >= 0).any():
            raise ValueError("pixels have alpha: write with alpha=True or flatten them")
        return rgb
    opacity = np.where(see_through < 0, 255, 255 - see_through).astype(np.uint8)
    return np.column_stack([np.frombuffer(rgb, np.uint8).reshape(-1, 3), opacity]).tobytes()


@dataclass
class Folder(WriterCommitMessage):
    name: str


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, alpha: bool, overwrite: bool):
        self.path, self.alpha, self.overwrite, self.stage = path, alpha, overwrite, staged(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        system, folder = storage(f"{self.stage}/{name}")
        system.create_dir(folder, recursive=True)
        image = height = due = 0
        png = None
        for batch in iterator:
            for row in batch.to_pylist():
                if png is None:
                    image, height, due = row["image_id"], row["height"], 0
                    out = system.open_output_stream(f"{folder}/{image}.png")
                    png = PngStream(out, row["width"], height, self.alpha)
                if (row["image_id"], row["y"], len(row["rgb"])) != (image, due, 3 * row["width"]):
                    raise ValueError(f"image {image} has gaps or repeated pixels at line {due}")
                png.line(samples(row["rgb"], row["alpha"], self.alpha))
                due += 1
                if due == height:
                    png.close()
                    png = None
        if png is not None:
            raise ValueError(f"image {image} ends at line {due} of {height}")
        return Folder(name)

    def commit(self, messages: list[Folder | None]) -> None:
        system, stage = storage(self.stage)
        system.create_dir(stage, recursive=True)
        kept = {m.name for m in messages if m is not None}
        for found in system.get_file_info(fs.FileSelector(stage)):
            if found.base_name not in kept:  # an attempt that was repeated elsewhere
                system.delete_dir(found.path)
        settle(self.stage, self.path, self.overwrite)

    def abort(self, messages: list[Folder | None]) -> None:
        discard(self.stage)


class ImageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pixelframe-images"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["path"], self.options.get("alpha") == "true", overwrite)


def save_images(df: DataFrame, path: str, alpha: bool = False, overwrite: bool = False) -> None:
    """Write every image as path/part-.../<image_id>.png with its exact samples.

    One shuffle of a row per scan line; a task holds one line at a time. With alpha the
    files have four channels and pixels without alpha become opaque; without it, pixels
    that have one are an error, as are gaps. An existing path is an error unless
    overwritten. A failed job leaves nothing at the path.
    """
    path = qualified(df.sparkSession, path)
    require(overwrite or not exists(path), f"{path} exists")
    df.sparkSession.dataSource.register(ImageSink)
    ordered = lines.packed(df).repartition("image_id").sortWithinPartitions("image_id", "y", "x")
    sink = ordered.write.format(ImageSink.name()).mode("overwrite" if overwrite else "append")
    sink.option("alpha", str(alpha).lower()).save(path)
