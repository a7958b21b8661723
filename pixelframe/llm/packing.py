"""Packing documents into windows of tokens by minimum bin slack.

A document's tokens are cut into full windows and one remainder. Remainders matter
only by length, so packing works on counts: how many remainders have each length (at
most capacity - 1 numbers, whatever the corpus). A step takes the longest remaining
length as seed, runs a subset-sum over bitsets on the remaining multiset and finds
the filling closest to capacity; backtracking gives how often each length is used.
The pattern is then applied as often as the counts allow, so the plan's size depends
on the capacity, not on the corpus. Each remainder learns its window from its rank
among those of its length; ranks come from counts per (length, slot), so one length
that holds a third of all rows is dealt over many slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import written
from .bpe import byte_letters
from .words import RUN_OF_SPACE, UNUSUAL, Pool, library, slices, spec, specials

CAPACITY = 1024


# --- ids of a byte-level vocabulary ------------------------------------------


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The same vocabulary as ranks: ids of a byte-level file ascend in merge order."""
    import tiktoken

    vocab, letters = spec(path)["model"]["vocab"], {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteEncoder:
    """Whole texts to ids; a chunk is a blank and what follows it up to the next."""

    def __init__(self, path: str):
        self.path, self.ranks = path, rank_encoder(path)  # the library itself is loaded for texts that need it
        self.cutter, self.special = specials(path)
        spec.cache_clear()  # the parsed file, several times the tables made of it
        self.pool = Pool(self.encode_new)

    def encode_new(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """A chunk: str (follows a blank), (str, first of its text) or (id, None)."""
        plain = self.ranks.encode_ordinary
        ids = []
        for c in chunks:
            if isinstance(c, str):
                ids.append(plain(" " + c))
            elif c[1] is None:
                ids.append([c[0]])
            elif c[1]:
                ids.append(plain(c[0]))
            else:
                ids.append(library(self.path).encode(c[0], add_special_tokens=False).ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for i in ids for x in i), np.uint32, int(lengths.sum())), lengths

    def chunks(self, text: str) -> list:
        if not text:
            return []
        if "<" in text and self.cutter and self.cutter.search(text):
            parts = self.cutter.split(text)
            return [c for p in parts for c in ([(self.special[p], None)] if p in self.special else self.chunks(p))]
        if UNUSUAL.search(text):
            return [(text, False)]
        if RUN_OF_SPACE.search(text) or text[0].isspace() or text[-1].isspace():
            return [(text, True)]
        out: list = text.split(" ")
        out[0] = (out[0], True)
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pool.gather([self.chunks(t) for t in texts])


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0,
           text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, doc_tokens and `parts`: (start, length, crc32 of the ids) of each piece."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("doc_tokens", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("crcs", T.ArrayType(T.LongType())),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_encoder(path)
        for part in parts:
            for start, texts in slices(part.column(1)):
                flat, counts = tool.ids(texts)
                raw = flat.astype("<u4").tobytes()
                stop = np.uint32(end_id).astype("<u4").tobytes()
                at, starts, crcs = 0, [], []
                for n in counts.tolist():
                    ids = raw[at:at + 4 * n] + stop
                    at += 4 * n
                    cuts = range(0, n + 1, capacity)
                    starts.append(list(cuts))
                    crcs.append([zlib.crc32(ids[4 * c:4 * (c + capacity)]) for c in cuts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(start, len(texts)), pa.array(counts + 1), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(crcs, pa.list_(pa.int64()))], [key, "doc_tokens", "starts", "crcs"])

    return df.select(key, text).mapInArrow(run, schema)


# --- the plan ------------------------------------------------------------------


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths whose sum is closest to room from below.

    Bit s of the set says that s can be reached. Counts are taken in powers of two;
    the sets before each step are kept to backtrack which steps were used.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room or reach >> room & 1:
            continue
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with their counts) until every remainder has a window."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        used = best_filling({n: c for n, c in left.items() if c}, capacity - seed)
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((times, used))
    return out


def assignment(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rank ranges (length, first, last, first window, uses, offset) and the window count.

    Remainder number r of a length, first <= r <= last, is in window
    first window + (r - first) div uses, at offset + length * ((r - first) mod uses).
    """
    taken: dict[int, int] = {}
    rows, window = [], 0
    for times, used in plan(counts, capacity):
        offset = 0
        for length, uses in sorted(used.items(), reverse=True):
            first = taken.get(length, 0)
            taken[length] = first + times * uses
            rows.append((length, first, taken[length] - 1, window, uses, offset))
            offset += length * uses
        window += times
    return rows, window


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, slots: int | None = None,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with end_id, so an empty or null text is one piece of one
    token; repeated rows are packed as documents of their own; an empty table gives
    no pieces. Windows of remainders come first in the numbering, full ones after.
    slots: over how many parts equal lengths are dealt; 64 to 1024 by the row count.
    """
    cut = written(pieces(df, path, capacity, end_id, text, key))
    slots = slots or max(64, min(1024, cut.count() // 200_000))
    cut = cut.withColumn(
        "slot", F.pmod(F.xxhash64(F.col(key), "doc_tokens", "crcs"), F.lit(slots))
    )
    spark = df.sparkSession
    tail = F.when(F.col("doc_tokens") % capacity == 0, 0).otherwise(F.col("doc_tokens") % capacity)
    cut = cut.withColumn("rest", tail.cast("long")).withColumn("full", F.expr(f"doc_tokens div {capacity}"))
    by_slot = cut.groupBy("rest", "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    counts: dict[int, int] = {}
    ranks, fulls, filled = [], [], 0  # at most capacity x slots numbers
    for rest, slot, n, full in sorted(map(tuple, by_slot)):
        ranks.append((rest, slot, counts.get(rest, 0), filled))
        counts[rest] = counts.get(rest, 0) + n
        filled += full
    counts.pop(0, None)
    ranges, windows = assignment(counts, capacity)
    base = spark.createDataFrame(ranks, "rest long, slot long, base long, full_base long")
    inside = Window.partitionBy("rest", "slot").orderBy(key, "doc_tokens", "crcs")
    cut = cut.join(F.broadcast(base), ["rest", "slot"])
    cut = cut.withColumns({
        "rank": F.col("base") + F.row_number().over(inside) - 1,
        "full_at": F.col("full_base") + F.sum("full").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"),
    })
    span = spark.createDataFrame(
        ranges, "rest long, first long, last long, window long, uses long, offset long"
    )
    rest = cut.where("rest > 0").join(
        F.broadcast(span), (cut["rest"] == span["rest"]) & F.col("rank").between(F.col("first"), F.col("last"))
    ).select(
        F.col(key), F.element_at("starts", -1).alias("start"), cut["rest"].alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        F.expr("window + (rank - first) div uses").alias("sequence_id"),
        (F.col("offset") + cut["rest"] * ((F.col("rank") - F.col("first")) % F.col("uses"))).alias("offset"),
    )
    whole = cut.where("full > 0").select(
        key, "doc_tokens", "full_at", F.posexplode(F.expr("slice(arrays_zip(starts, crcs), 1, int(full))")).alias("i", "p")
    ).select(
        key, F.col("p.starts").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("p.crcs").alias("ids_crc32"),
        "doc_tokens", (F.lit(windows) + F.col("full_at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return rest.unionByName(whole)
