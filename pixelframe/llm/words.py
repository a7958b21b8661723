"""Token ids of whole texts through the distinct chunks they are made of.

The pre-tokenisers never let a piece cross a border between white space and a word,
so a text's ids are the ids of its chunks in a row. A chunk is encoded once per
worker; after that a text costs one dictionary lookup per word and one gather.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Outside these characters Python's and the tokenisers' ideas of letters, digits,
# white space and lower case may differ; such texts take the library's own splitter.
UNUSUAL = re.compile(
    "[\x00-\x08\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbeİɐ-‏"
    " -  -₫₭-\U0010ffff]"
)
RUN_OF_SPACE = re.compile(r"\s\s")
MAX_CHUNKS, MAX_CHUNK_CHARS = 300_000, 16_000_000  # a worker forgets its chunks beyond these
SLICE_CHARS = 1_000_000  # texts handled at once


@lru_cache(maxsize=4)
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Added tokens, which are cut out of a text before anything else."""
    added = spec(path)["added_tokens"]
    for t in added:
        if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"added token {t['content']!r} needs the library's own matching")
    ids = {t["content"]: t["id"] for t in added}
    found = "|".join(map(re.escape, sorted(ids, key=len, reverse=True)))
    return (re.compile(f"({found})") if ids else None), ids


class Numbers(dict):
    """Numbers its keys as they come; fresh lists those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Pool:
    """Ids of distinct chunks; encode_new gives (flat ids, lengths) of new ones."""

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self.clear()

    def clear(self) -> None:
        self.numbers, self.held = Numbers(), 0
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def gather(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of ids of each; texts are chunk lists."""
        if len(self.numbers) > MAX_CHUNKS or self.held > MAX_CHUNK_CHARS:
            self.clear()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(counts.sum())
        look = self.numbers.__getitem__
        at = np.fromiter((n for t in texts for n in map(look, t)), np.int64, total)
        if self.numbers.fresh:
            flat, lengths = self.encode_new(self.numbers.fresh)
            # a chunk is text, or a tuple that may hold a whole text
            self.held += sum(len(c if isinstance(c, (str, bytes)) else str(c[0])) for c in self.numbers.fresh)
            self.numbers.fresh.clear()
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if total else 0
        take = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(n)
        done = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[take], np.diff(done)


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) of a column, a few MB at a time; null is the empty text."""
    start, part, size = 0, [], 0
    for value in column:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield start, part
            start, part, size = start + len(part), [], 0
    if part:
        yield start, part
