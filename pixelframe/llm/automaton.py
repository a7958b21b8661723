"""Repeated word windows through suffix automata of reference shards.

A window is 13 words of one document. It is removed if it also starts in a document
with a smaller key: the words covered by removed windows go.

A window is named by the smallest hash of its runs of four words, so equal windows have
equal names. Consecutive windows whose name comes from the same place are one passage,
at most 22 words. Names that occur in one document only are dropped; of equal passages
the one in the smallest document is a reference. A reference shard holds the passages
of some names, so a document's windows meet only the shard that can hold them; the
shard's suffix automaton (words as letters, several passages) knows for each state the
smallest document in which its strings end. Passages are streamed through the automaton:
their matching statistics say how long the match that ends at a word is, and the state of
the match's last 13 words says in which document the window starts first. That answer
goes to all occurrences of the passage, which is the broadcast: by a join, since what is
repeated grows with the corpus and has no place on the driver or whole in a task.

A name with more than CROWD different passages (a line in ever other surroundings) is
taken apart: its windows are passages of their own, named by themselves and counted
before the shuffle, so a shard holds at most SHARD + CROWD passages and no task depends
on how often a passage or a name occurs.

Passages and words are recognised by 64-bit hashes; the automaton compares words.

Defined cases: a null text has no words; a null key counts as the largest number; rows
with one key are never smaller than each other, whatever their texts; equal rows give
equal rows; windows that repeat only inside a document stay; an empty table gives none;
other columns play no part; a text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import whole_text, written

WINDOW = 13
PIECE = 4
CROWD = 64  # different passages of a name, beyond which its windows are passages of their own
SHARD = 512  # passages of a shard, besides those of its last name
LAST = (1 << 63) - 1  # the number of a null key, and of no document
LONG = 64  # bytes; longer words are hashed one by one
SLICE_BYTES = 2_000_000  # texts handled at once


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # ASCII white space: x20, x09 to x0D


class Automaton:
    """Suffix automaton of several word sequences; first: smallest document of each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    def split(self, p: int, word) -> int:
        """The state after p and word, cut off from longer strings if it has some."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        short = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = short
            p = self.link[p]
        self.link[q] = short
        return short

    def add(self, words: list, document: int) -> None:
        """A reference sequence of a document."""
        step, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            if word in step[last]:
                last = self.split(last, word)
                if document < first[last]:
                    first[last] = document
                continue
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(document)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = self.split(p, word)
            last = new

    def finish(self) -> None:
        """Documents go up to all shorter strings that end at the same places."""
        link, first = self.link, self.first
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if first[s] < first[link[s]]:
                first[link[s]] = first[s]

    def statistics(self, words: list, least: int) -> Iterator[tuple[int, int]]:
        """Per word: length of the longest match that ends there, and the smallest document
        that holds its last `least` words (LAST if the match is shorter)."""
        step, link, length = self.next, self.link, self.length
        at = matched = 0
        for word in words:
            while at and word not in step[at]:
                at = link[at]
                matched = length[at]
            at = step[at].get(word, 0)
            matched = matched + 1 if at else 0
            if matched < least:
                yield matched, LAST
                continue
            u = at
            while length[link[u]] >= least:
                u = link[u]
            yield matched, self.first[u]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LETTER = np.where(SPACE, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)))
PLACE = np.append(mixed(np.arange(1000, 1000 + LONG, dtype=np.uint64)) | np.uint64(1), np.uint64(0))


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their borders in bytes: sums of letter times place, spread."""
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 1 << 17):
        s, e = starts[low:low + (1 << 17)], ends[low:low + (1 << 17)]
        value = LETTER[raw[s[0]:e[-1]]]
        inside = np.arange(len(value)) - np.repeat(s - s[0], np.diff(np.append(s, e[-1])))
        value *= PLACE[np.minimum(inside, LONG)]
        out[low:low + len(s)] = np.add.reduceat(value, s - s[0])
    size = ends - starts
    out = mixed(out + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    if size.size and size.max() > LONG:
        from xxhash import xxh64_intdigest

        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxh64_intdigest(raw[starts[i]:ends[i]].tobytes())
    return out


def passages(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, name, digest, first window, number of windows) of every passage.

    raw: the bytes of some texts in a row; borders: where each begins, and the end.
    """
    none = (np.empty(0, np.int64),) * 5
    edge = np.zeros(len(raw) + 1, bool)
    edge[borders] = True
    gap = np.append(SPACE[raw], True)
    starts = np.flatnonzero(~gap[:-1] & (edge[:-1] | np.append(True, gap[:-2])))
    ends = np.flatnonzero(~gap[:-1] & (edge[1:] | gap[1:])) + 1
    windows = len(starts) - WINDOW + 1
    if windows < 1:
        return none
    h = hashed(raw, starts, ends)
    text = np.searchsorted(borders, starts, "right") - 1
    factor = np.uint64(0xD6E8FEB86659FD93)
    piece = h[:len(h) - PIECE + 1].copy()
    for j in range(1, PIECE):
        piece = mixed(piece * factor + h[j:len(piece) + j])
    whole = piece[:windows].copy()
    for j in range(PIECE, WINDOW - PIECE + 1, PIECE):
        whole = mixed(whole * factor + piece[j:j + windows])
    for j in range(WINDOW - WINDOW % PIECE, WINDOW):
        whole = mixed(whole * factor + h[j:j + windows])
    least, place = piece[:windows].copy(), np.arange(windows)
    for j in range(1, WINDOW - PIECE + 1):
        less = np.flatnonzero(piece[j:j + windows] < least)
        least[less] = piece[less + j]
        place[less] = less + j
    inside = np.flatnonzero(text[:windows] == text[WINDOW - 1:])
    if not len(inside):
        return none
    new = np.ones(len(inside), bool)
    new[1:] = (place[inside[1:]] != place[inside[:-1]]) | (np.diff(inside) != 1)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(inside)))
    low, high = inside[start], inside[start + count - 1]
    # first and last window cover a passage whole
    digest = mixed(mixed(whole[low] * factor + whole[high]) + count.astype(np.uint64))
    at = low - np.searchsorted(text, text[low])
    return text[low], least[low].view(np.int64), digest.view(np.int64), at, count


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, borders) of a column of texts without nulls, a few MB at a time."""
    wide = column.cast(pa.large_string())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield at, raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def base(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, tag, text: the key as a number, and what tells texts of one key apart."""
    body = whole_text(text)
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"),
                     (F.crc32(body.cast("binary")) - (1 << 31)).cast("int").alias("tag"), body.alias("text"))


def occurrences(docs: DataFrame, names_only: bool) -> DataFrame:
    """(name, doc), or (name, digest, doc, tag, pos, n): every passage of every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc, tag = part.column(0).to_numpy(), part.column(1).to_numpy()
            for start, raw, borders in slices(part.column(2)):
                text, name, digest, pos, n = passages(raw, borders)
                columns = [name, doc[start + text]]
                names = ["name", "doc"]
                if not names_only:
                    columns += [digest, tag[start + text], pos.astype(np.int32), n.astype(np.int32)]
                    names += ["digest", "tag", "pos", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    more = "" if names_only else ", digest long, tag int, pos int, n int"
    return docs.mapInArrow(run, f"name long, doc long{more}")


def cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, digest, crowded, at: doc, tag, pos, n) with the passages' words as text."""
    lists = wanted.groupBy(F.col("at.doc").alias("doc"), F.col("at.tag").alias("tag")).agg(
        F.collect_list(F.struct("name", "digest", "crowded", F.col("at.pos").alias("pos"), F.col("at.n").alias("n"))).alias("list"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # equal rows need be read once
        for part in parts:
            kept, documents, found = [], [], []
            for doc, tag, text, at in zip(*(c.to_pylist() for c in part.columns[:3]), part.column(3)):
                if (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                words, own = words_of(text), at.values
                kept.append(own)
                documents += [doc] * len(own)
                found += [b" ".join(words[p:p + k + WINDOW - 1]) for p, k in zip(own.field("pos").to_pylist(), own.field("n").to_pylist())]
            if found:
                name, digest, crowded, *_ = pa.concat_arrays(kept).flatten()
                yield pa.RecordBatch.from_arrays(
                    [name, digest, crowded, pa.array(documents, pa.int64()), pa.array(found, pa.binary())],
                    ["name", "digest", "crowded", "first", "words"])

    return docs.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "list").mapInArrow(
        run, "name long, digest long, crowded boolean, first long, words binary")


def matched(passages: DataFrame, size: int = SHARD) -> DataFrame:
    """(name, digest, firsts): for every window of a passage the smallest document that has it.

    passages: name, digest, first, words; a shard takes names until it has `size` passages.
    """
    dealt = passages.select("name", "digest", "first", "words").repartition("name").sortWithinPartitions("name")

    def answers(shard: dict) -> pa.RecordBatch:
        automaton, split = Automaton(), []
        for (name, digest), (first, words) in shard.items():
            split.append(words.split())
            automaton.add(split[-1], first)
        automaton.finish()
        firsts = [[first for length, first in automaton.statistics(s, WINDOW) if length >= WINDOW] for s in split]
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in shard], pa.int64()), pa.array([d for _, d in shard], pa.int64()),
             pa.array(firsts, pa.list_(pa.int64()))], ["name", "digest", "firsts"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = {}, None
        for part in parts:
            for name, digest, first, words in zip(*(c.to_pylist() for c in part.columns)):
                if name != last and len(shard) >= size:
                    yield answers(shard)
                    shard = {}
                last = name
                shard[name, digest] = first, words
        if shard:
            yield answers(shard)

    return dealt.mapInArrow(run, "name long, digest long, firsts array<long>")


def windows_of(passages: DataFrame) -> DataFrame:
    """(name, digest, i, window, first, words): the windows of passages, named by themselves."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in parts:
            out = []
            for name, digest, first, text in zip(*(c.to_pylist() for c in part.columns)):
                words = text.split()
                for i in range(len(words) - WINDOW + 1):
                    own = b" ".join(words[i:i + WINDOW])
                    out.append((name, digest, i, xxh64_intdigest(own) - (1 << 63), first, own))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["name", "digest", "i", "window", "first", "words"])

    return passages.select("name", "digest", "first", "words").mapInArrow(
        run, "name long, digest long, i int, window long, first long, words binary")


def answered(passages: DataFrame) -> DataFrame:
    """(name, digest, firsts) of all reference passages, crowded names window by window."""
    parts = windows_of(passages.where("crowded"))
    alone = parts.groupBy("window").agg(F.min("first").alias("first"), F.min("words").alias("words"))
    single = matched(alone.select(F.col("window").alias("name"), F.col("window").alias("digest"), "first", "words"))
    of = parts.select("name", "digest", "i", "window").join(
        single.select(F.col("name").alias("window"), F.element_at("firsts", 1).alias("least")), "window")
    again = of.groupBy("name", "digest").agg(F.array_sort(F.collect_set(F.struct("i", "least"))).alias("all"))
    return matched(passages.where("NOT crowded")).union(again.select("name", "digest", F.col("all.least")))


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD, as_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, n_spans (maximal removed runs) and kept_sha256, or the kept words as text."""
    docs = base(df, key, text)
    names = occurrences(docs, names_only=True).groupBy("name").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    names = written(names.where("low < high").select("name"))  # the join can deal hot names anew only if nothing is grouped in it
    shared = written(occurrences(docs, names_only=False).join(names, "name", "left_semi"))
    kinds = shared.groupBy("name", "digest").agg(F.min(F.struct("doc", "tag", "pos", "n")).alias("at"))
    crowds = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > crowd)
    wanted = kinds.join(crowds, "name", "left").withColumn("crowded", F.col("kinds").isNotNull())
    firsts = answered(written(cut_out(docs, wanted)))
    gone = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc"), F.col("pos") + i)), lambda p: p.isNotNull())
    marks = shared.join(firsts, ["name", "digest"]).select("doc", "tag", gone.alias("gone")).where(F.size("gone") > 0)
    marks = marks.groupBy("doc", "tag").agg(F.flatten(F.collect_set("gone")).alias("gone"))
    key_type = df.schema[key].dataType.simpleString()
    whole = docs.join(marks, ["doc", "tag"], "left").select("doc", "text", "gone")
    last = "kept" if as_text else "kept_sha256"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for body, gone in zip(part.column(1), part.column(2)):
                words = words_of(body.as_py())
                change = np.zeros(len(words) + 1, np.int64)
                if gone.is_valid:
                    at = gone.values.to_numpy()
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
                drop = np.cumsum(change)[:-1] > 0
                kept = b" ".join([w for w, d in zip(words, drop.tolist()) if not d])
                spans = int(drop[:1].sum() + (drop[1:] & ~drop[:-1]).sum())
                out.append((len(words), int(drop.sum()), spans, kept.decode() if as_text else sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             ["doc", "n_words", "n_removed", "n_spans", last])

    found = whole.mapInArrow(run, f"doc long, n_words long, n_removed long, n_spans long, {last} string")
    return found.select(F.when(F.col("doc") != LAST, F.col("doc")).cast(key_type).alias(key), "n_words", "n_removed", "n_spans", last)


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS i FROM w)),
least AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i + 1, i + 14)) AS p FROM wins JOIN least USING (win) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
told AS (
  SELECT doc_id, e.p, word, g.p IS NOT NULL AS cut, coalesce(lag(g.p) OVER (PARTITION BY doc_id ORDER BY e.p) IS NULL, true) AS fresh
  FROM each e LEFT JOIN gone g USING (doc_id, p)),
sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (cut) AS n_removed, count(*) FILTER (cut AND fresh) AS n_spans,
    string_agg(word, ' ' ORDER BY p) FILTER (NOT cut) AS kept
  FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
