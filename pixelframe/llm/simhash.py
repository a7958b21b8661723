"""SimHash fingerprints and their near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is dealt into three segments of 22, 21 and 21 bits. Each is
filled up to 23 bits and decoded with the perfect binary Golay code: its keys are
the numbers of all codewords within distance 4, one if the nearest lies within 2,
six otherwise. Two words at distance 2 or less have a midpoint within 1 of both,
and a codeword lies within 3 of that midpoint, so they share a key. Of two or fewer
differing bits at least one segment has none (pigeonhole), and the segment after it
two or fewer: a pair shares the exact bits of the one and a key of the other, for one
of three places. That gives at most 18 keys of 33 bits each. Pairs with a common key
are verified by their distance.

Keys with more than `dense` fingerprints (one large group of near copies) are not
joined within: their fingerprints are written to the 65 points within distance 1.
Two fingerprints have a common point if and only if they differ in two bits or fewer,
so hanging all on the point's smallest links the same groups with 65 rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import written
from .graph import components
from .words import slices

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # offset, bits
GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1, fixed value


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def leaders() -> np.ndarray:
    """The error of weight 3 or less that belongs to each of the 2048 remainders."""
    bits = [1 << i for i in range(23)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.full(2048, -1, np.int64)
    table[syndromes(np.array(errors, np.int64))] = errors
    return table


LEADERS = leaders()


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword numbers within distance 4 of 23-bit words; repeats are -1."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int64))], axis=1)
    codes = (near ^ LEADERS[syndromes(near)]) >> 11
    codes.sort(axis=1)
    codes[:, 1:][codes[:, 1:] == codes[:, :-1]] = -1
    return codes


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for 64-bit fingerprints; a key names place, exact bits and codeword."""
    prints = prints.view(np.uint64)
    parts = [((prints >> np.uint64(o)) & np.uint64((1 << b) - 1)).astype(np.int64) for o, b in SEGMENTS]
    rows, keys = [], []
    for s in range(3):
        codes = golay_keys(parts[(s + 1) % 3])
        at, col = np.nonzero(codes >= 0)
        rows.append(at)
        keys.append((s << 40) | (parts[s][at] << 12) | codes[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_print(text: str, width: int) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    raw = b" ".join(text.encode().lower().split())
    if not raw:
        return 0
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(raw)]
    n = max(1, len(starts) - width + 1)
    ends = ends[min(width, len(ends)) - 1:]
    hashes = np.array([xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts[:n], ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = 3) -> DataFrame:
    """The kept columns and `print`, a signed 64-bit fingerprint of the whole text."""
    names = list(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(part.schema.get_field_index(text))
            for start, texts in slices(column):
                found = pa.array([shingle_print(t, width) for t in texts], pa.int64())
                rest = part.select(names).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*rest.columns, found], [*names, "print"])

    fields = [*df.select(*names).schema.fields, T.StructField("print", T.LongType())]
    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType(fields))


def keyed(prints: DataFrame) -> DataFrame:
    """(key, print) for distinct fingerprints."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 8192):
                own = part.column(0).slice(at, 8192).to_numpy()
                rows, keys = fuzzy_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["key", "print"])

    return prints.select("print").mapInArrow(run, "key long, print long")


def links(prints: DataFrame, distance: int = 2, dense: int = 64) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect all within distance."""
    if distance != 2:
        raise ValueError("keys and points are made for two differing bits")
    keys = written(keyed(prints))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = keys.join(sizes, "key")
    few = crowd.where(F.col("n") <= dense)
    a, b = few.select("key", F.col("print").alias("u")), few.select("key", F.col("print").alias("v"))
    pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance))
    one_bit = F.array(*[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)], F.lit(0).cast("long"))
    ball = crowd.where(F.col("n") > dense).select("print").distinct().withColumn("bit", F.explode(one_bit))
    ball = ball.select("print", F.col("print").bitwiseXOR(F.col("bit")).alias("point"))
    heads = ball.groupBy("point").agg(F.min("print").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hung = ball.join(heads, "point").select(F.col("head").alias("u"), F.col("print").alias("v")).where("u <> v")
    return pairs.select("u", "v").union(hung).distinct()


def grouped(df: DataFrame, keep: tuple[str, ...], key: str, text: str, width: int) -> DataFrame:
    """The kept columns, print, group (a fingerprint of it) and component_id."""
    prints = written(fingerprints(df, tuple(dict.fromkeys((key, *keep))), text, width))
    distinct = written(prints.groupBy("print").agg(F.min(key).alias("least")))
    group = components(links(distinct))
    of = distinct.join(group, distinct["print"] == group["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("group")
    )
    least = of.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(least, "group").select("print", "group", "component_id"), "print")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id: the smallest key linked with it.

    One row per input row. Null, empty and blank texts have fingerprint zero and link
    like any other; rows with a null key belong to their group but never name it; a
    group of null keys only has a null component. Repeated rows stay.
    """
    found = grouped(df, (), key, text, width)
    return found.select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of df that stand for their group: smallest key, then smallest row hash."""
    tagged = df.withColumn("_row", F.xxhash64(*map(F.col, df.columns)))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_row").alias("row"))
    first = grouped(tagged, ("_row",), key, text, width).groupBy("group").agg(F.min(order).alias("o"))
    kept = tagged.join(first.select(F.col("o.row").alias("_row")), "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(*df.columns)
