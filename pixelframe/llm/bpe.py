"""Byte pair encoding by a pair occurrence index, and decoding.

All new chunks of a slice are laid out in one row of symbols with walls between
them. An index maps each mergeable pair to all its positions in that row; ranks
that occur are taken in ascending order from a heap, every position of the pair is
merged, and the lists of the pairs that arise are extended. A rank that appears
while merging is always higher than the one at work, because a token can only be
part of merges that come after the one that made it; the loader checks this.

encode: a row per input row with the kept columns, `ids` (binary, little-endian
unsigned 32-bit) and `n_tokens`. A null text counts as empty and gives no ids;
repeated rows give repeated rows; an empty table gives none; texts of any length are
encoded whole. decode is the inverse view: ids to text, special tokens included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import UNUSUAL, Pool, library, slices, spec, specials

# The splitting pattern of both tokenizers' files, as Python's re reads it on the
# usual characters; fixed values.
WORD_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
WALL, GONE = -1, -2


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Merges:
    """Vocabulary and merges of a BPE file, by numbers."""

    def __init__(self, path: str):
        model = spec(path)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE model")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.made: list[tuple[int, int, int]] = []
        born: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            triple = (vocab[a], vocab[b], vocab[a + b])
            if max(born.get(triple[0], -1), born.get(triple[1], -1)) >= rank:
                raise ValueError("a merge uses a token that is made later")
            born[triple[2]] = rank
            self.made.append(triple)
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.made)}
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of chunks, each a single piece of the pre-tokeniser."""
        sym: list[int] = []
        first, last = self.first, self.last
        for chunk in chunks:
            raw = chunk.encode()
            sym.extend(map(first.__getitem__, raw))
            if raw:
                sym[-1] = last[raw[-1]]
            sym.append(WALL)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where = self.occurrences(sym)
        heap = list(where)
        heapify(heap)
        rank_of, made = self.rank.get, self.made
        while heap:
            rank = heappop(heap)
            spots = where.pop(rank)
            a, b, c = made[rank]
            if a == b:
                spots.sort()
            for p in spots:
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue  # merged away meanwhile
                sym[p], sym[q] = c, GONE
                s, o = after[q], before[p]
                after[p] = s
                if s < n:
                    before[s] = p
                if sym[o] >= 0:
                    r = rank_of(sym[o] << 20 | c)
                    if r is not None:
                        if r in where:
                            where[r].append(o)
                        else:
                            where[r] = [o]
                            heappush(heap, r)
                if sym[s] >= 0:
                    r = rank_of(c << 20 | sym[s])
                    if r is not None:
                        if r in where:
                            where[r].append(p)
                        else:
                            where[r] = [p]
                            heappush(heap, r)
        left = np.array(sym, np.int64)
        left = left[left != GONE]
        walls = np.flatnonzero(left == WALL)
        lengths = np.diff(np.concatenate([[-1], walls])) - 1
        return left[left != WALL].astype(np.uint32), lengths

    def occurrences(self, sym: list[int]) -> dict[int, list[int]]:
        """Rank of a pair -> its positions, ascending."""
        s = np.array(sym, np.int64)
        if len(s) < 2 or not len(self.keys):
            return {}
        pair = np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] << 20 | s[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        spots = np.flatnonzero(self.keys[at] == pair)
        ranks = self.by_key[at[spots]]
        order = np.argsort(ranks, kind="stable")
        ranks, spots = ranks[order], spots[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        heads = ranks[np.concatenate([[0], cuts])] if len(ranks) else []
        return {int(r): part.tolist() for r, part in zip(heads, np.split(spots, cuts))}


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Whole texts to ids for vocabularies that drop white space and lower the case."""

    def __init__(self, path: str):
        data = spec(path)
        kinds = [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizer {kinds} is not supported")
        self.path, self.model, self.tool = path, merges(path), library(path)
        self.cutter, self.special = specials(path)
        self.unletter = {c: b for b, c in enumerate(byte_letters())}
        self.pool = Pool(self.encode_new)

    def encode_new(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """A chunk: a run of non-space, a special token's id, or (piece, None) as split."""
        pieces, counts = [], []
        for chunk in chunks:
            if isinstance(chunk, str):
                found = WORD_PATTERN.findall(chunk)
            else:
                found = [chunk[0]] if chunk[1] is None else []
            pieces += found
            counts.append(len(found))
        flat, sizes = self.model.encode(pieces)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        marks = [(i, c[1]) for i, c in enumerate(chunks) if not isinstance(c, str) and c[1] is not None]
        if marks:
            spots = (np.cumsum(lengths) - lengths)[[i for i, _ in marks]]
            flat = np.insert(flat, spots, [v for _, v in marks])
            lengths[[i for i, _ in marks]] = 1
        return flat, lengths

    def chunks(self, text: str) -> list:
        if "<" in text and self.cutter and self.cutter.search(text):
            out: list = []
            for part in self.cutter.split(text):
                out += [("", self.special[part])] if part in self.special else self.chunks(part)
            return out
        if not UNUSUAL.search(text):
            return text.lower().split()
        normal = self.tool.normalizer.normalize_str(text)
        pieces = self.tool.pre_tokenizer.pre_tokenize_str(normal)
        return [(bytes(map(self.unletter.__getitem__, p)).decode(), None) for p, _ in pieces]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pool.gather([self.chunks(t) for t in texts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def token_texts(path: str) -> list[str]:
    data = spec(path)
    if data["decoder"] is not None:
        raise ValueError("only files without a decoder are supported")
    table = {i: t for t, i in data["model"]["vocab"].items()}
    table |= {t["id"]: t["content"] for t in data["added_tokens"]}
    return [table.get(i, "") for i in range(max(table) + 1)]


def batches(part: pa.RecordBatch, keep: list[str], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    index = part.schema.get_field_index(column)
    for start, texts in slices(part.column(index)):
        yield part.select(keep).slice(start, len(texts)), texts


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids (binary) and n_tokens of every whole text."""
    if {"ids", "n_tokens", text} & set(keep):
        raise ValueError("kept columns may not be called ids, n_tokens or like the text")
    names = list(keep)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for part in parts:
            for rest, texts in batches(part, names, text):
                flat, counts = tool.ids(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                raw = flat.astype("<u4").tobytes()
                ids = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.columns, ids, pa.array(counts)], [*names, "ids", "n_tokens"])

    fields = [*df.select(*names).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return df.select(*names, text).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `decoded`: the tokens of every id list, joined by blanks."""
    if "decoded" in keep:
        raise ValueError("a kept column is called decoded")
    names = list(dict.fromkeys(keep))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = token_texts(path).__getitem__
        for part in parts:
            raw = part.column(part.schema.get_field_index(ids))
            for start in range(0, max(len(raw), 1), 256):  # bounded memory
                some = raw.slice(start, 256)
                texts = [" ".join(map(look, np.frombuffer(v.as_py() or b"", "<u4").tolist())) for v in some]
                rest = part.select(names).slice(start, 256)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = [*df.select(*names).schema.fields, T.StructField("decoded", T.StringType())]
    return df.select(*names, *([] if ids in names else [ids])).mapInArrow(run, T.StructType(fields))


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    coded = encode(df, path).withColumn("ids_sha256", F.sha2("ids", 256))
    plain = decode(coded, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return plain.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
