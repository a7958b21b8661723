"""Exact repeated passages: suffix sorting in two stages on the windows that may repeat.

A window is a string of `length` bytes. The smallest of the hashes of its `gram`-byte
pieces names its bucket: equal windows have equal names wherever they stand, so only
windows of one bucket need comparing. Consecutive windows with one name form a
segment, whose hash is counted together with its name:

* a segment that occurs more than once repeats as a whole, at every place;
* a name with one segment that occurs once repeats at most inside that segment, if it
  is periodic; that is settled where the text is read;
* of names with several different segments, one copy of each segment is fetched and
  its windows are sorted as suffixes.

The sort has two stages. Suffixes whose first byte is not larger than the next one's
are sorted directly; all others are induced: walking through the buckets of first
bytes in ascending order, the suffix before each one met is put next into its own
bucket. Neighbours in the sorted order whose common prefix has `length` bytes repeat.

A name with very many different segments (a passage that a third of all documents
share, each with its own surroundings) isn't compared: its segments are texts of the
next round, which names their windows by longer pieces. Windows that reach into private
surroundings part company there; the last round's piece is the window itself. A segment
gives a few rows a round, so the rows are in proportion to the segments, however many
share a name, and no task meets more than CROWDED segments of one name.

Passages may also be measured in words, whatever their bytes: a text is then read as the
32-bit hashes of its words in a row, and a window is a number of words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .automaton import SPACE, hashed
from .common import whole_text, written

LENGTH = 400
GRAM = 100
RUN = 256  # windows of a segment at most
BLOCK_BYTES = 500_000  # of segments sorted at once
CODE = 4  # bytes that stand for a word
AT_ONCE = 4096  # windows put in order together, each with its own copy of its bytes
CROWDED = 1000  # different segments of a name that are compared; with more, they are named anew
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            steps = np.ones(size, np.uint64)
            steps[1:] = BASE
            self.up = np.multiply.accumulate(steps)
            steps[1:] = inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every gram-byte piece."""
    n = len(data)
    up, down = POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values."""
    n = len(values)
    if width == 1:
        return values
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1:width - 1 + m])


def segments(raw: bytes, length: int, gram: int) -> tuple:
    """Names, first and last window starts and hashes of a text's segments, and the runs
    of windows that repeat inside the segment they are in."""
    from xxhash import xxh3_64_intdigest

    width = length - gram + 1
    grams = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    names = sliding_min(grams, width)
    cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts - 1, [len(names) - 1]])
    # windows of one segment can only be equal if the naming piece occurs in it twice
    spots = zip(first.tolist(), last.tolist(), names[first].tolist())
    twice = [i for i, (a, b, v) in enumerate(spots) if np.count_nonzero(grams[a:b + width] == v) > 1]
    inner = [(first[i] + a, first[i] + b) for i in twice for a, b in equal_inside(raw[first[i]:last[i] + length], length)]
    if (last - first >= RUN).any():
        parts = (last - first) // RUN + 1
        at = np.repeat(first, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        last = np.minimum(at + RUN - 1, np.repeat(last, parts))
        first = at
    hashes = [xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
    return names[first], first, last, hashes, inner


def equal_inside(raw: bytes, length: int) -> list[tuple[int, int]]:
    """Runs of the windows of a periodic segment that occur in it again."""
    hashes = gram_hashes(np.frombuffer(raw, np.uint8), length)
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    here = np.arange(len(hashes))
    shift = here - where[back]
    again = np.zeros(len(hashes), bool)
    cuts = np.flatnonzero(np.diff(shift)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)]):
        s = int(shift[a])
        if s and raw[a:b - 1 + length] == raw[a - s:b - 1 - s + length]:  # equal hashes are checked by their bytes
            again[a:b] = again[a - s:b - s] = True
    return runs(again)


def segment_table(texts: DataFrame, length: int, gram: int, words: int | None = None) -> DataFrame:
    """(name, segment, key, first, last, settled) of every text with a window.

    texts: key, raw (bytes), settled. Rows without a name are runs of windows that repeat
    inside a segment. words: the texts are read as the hashes of their words; that is done
    here, since a second step in Python would be a second process for each task.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list] = [[], [], [], [], [], [], []]
            size = 0

            def batch() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in out]
                return pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].view(np.int64), mask=columns[6]), *(pa.array(c) for c in (columns[1].view(np.int64), *columns[2:6]))],
                    ["name", "segment", "key", "first", "last", "settled"])

            for key, text, settled in zip(part.column(0), part.column(1), part.column(2)):
                raw = text.as_py()
                raw = code_of(raw, words) if words else raw
                if len(raw) < length:
                    continue
                names, first, last, hashes, inner = segments(raw, length, gram)
                n, m = len(names), len(inner)
                ends = np.array(inner, np.int32).reshape(-1, 2)
                nothing = np.zeros(m, np.uint64)
                for column, values in zip(out, (
                    np.concatenate([names, nothing]), np.concatenate([np.array(hashes, np.uint64), nothing]),
                    np.full(n + m, key.as_py(), np.int64), np.concatenate([first.astype(np.int32), ends[:, 0]]),
                    np.concatenate([last.astype(np.int32), ends[:, 1]]), np.full(n + m, settled.as_py()), np.arange(n + m) >= n,
                )):
                    column.append(values)
                size += n + m
                if size > 100_000:
                    yield batch()
                    out, size = [[], [], [], [], [], [], []], 0
            if size:
                yield batch()

    return texts.mapInArrow(run, "name long, segment long, key long, first int, last int, settled boolean")


# --- two-stage suffix sorting ---------------------------------------------------


def sort_windows(data: bytes, starts: np.ndarray, tails: np.ndarray, length: int) -> np.ndarray:
    """Window starts in the order of their `length` bytes.

    starts ascend; tails marks those whose successor start + 1 is not among them.
    """
    t = np.frombuffer(data, np.uint8)
    head, second = t[starts], t[starts + 1]
    index = np.full(len(data) + 1, -1, np.int64)
    index[starts] = np.arange(len(starts))
    falls = head > second  # larger than its successor
    window = lambda p: data[p:p + length]

    rises = ~falls | tails
    direct, lead = starts[rises], (head[rises].astype(np.int32) << 8) | second[rises]
    order = np.argsort(lead, kind="stable")  # by two bytes, so that few whole windows are held at once
    direct, lead = direct[order], lead[order]
    parts, at = [], 0
    for end in [*(np.flatnonzero(np.diff(lead)) + 1).tolist(), len(direct)]:
        if end - at >= AT_ONCE or end == len(direct):
            parts.append(np.array(sorted(direct[at:end].tolist(), key=window), np.int64))
            at = end
    ordered = np.concatenate(parts)
    is_fall = falls[index[ordered]]
    rising, loose = ordered[~is_fall], ordered[is_fall]  # loose: tails to be put among the induced
    rising_cut = np.searchsorted(t[rising], np.arange(257))
    loose_cut = np.searchsorted(t[loose], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        induced = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        extra = loose[loose_cut[c]:loose_cut[c + 1]]
        if len(extra):
            line = induced.tolist()
            spots = [bisect_left(line, window(p), key=window) for p in extra.tolist()]
            induced = np.insert(induced, spots, extra)
        bucket = np.concatenate([induced, rising[rising_cut[c]:rising_cut[c + 1]]])
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket - 1
        before = before[(before >= 0) & (index[before] >= 0)]
        heads = t[before]
        fits = (heads > c) & ~tails[index[before]]
        before, heads = before[fits], heads[fits]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            waiting[t[part[0]]].append(part)
    return np.concatenate(done) if done else starts


def common_prefix_full(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of the order shares all its bytes with the next one."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same = np.zeros(len(order) - 1, bool)
    alive = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    for at in [*range(0, length - 7, 8), length - 8]:
        left = np.ascontiguousarray(words[a[alive] + at]).view(np.uint64).ravel()
        right = np.ascontiguousarray(words[b[alive] + at]).view(np.uint64).ravel()
        alive = alive[left == right]
        if not len(alive):
            break
    same[alive] = True
    return same


def repeated(pieces: list[bytes], widths: list[int], length: int, settled: list[bool] | None = None) -> list[np.ndarray]:
    """For each piece which of its first `width` windows occur again.

    Windows whose rolling hash is single can't repeat and aren't sorted; nor are those
    that only pieces already settled share (their answers don't matter).
    """
    data = b"".join(pieces)
    base = np.cumsum([0, *map(len, pieces)])[:-1]
    wide = np.array(widths)
    starts = np.repeat(base - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
    hashes = gram_hashes(np.frombuffer(data, np.uint8), length)[starts]
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    asked = np.repeat(~np.array(settled or [False] * len(pieces)), wide)
    hit = np.zeros(len(data), bool)
    chosen = starts[((count > 1) & (np.bincount(back, asked) > 0))[back]]
    if len(chosen):
        tails = np.append(np.diff(chosen) != 1, True)
        order = sort_windows(data, chosen, tails, length)
        same = common_prefix_full(data, order, length)
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
    return [hit[b:b + w] for b, w in zip(base, widths)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


PIECE = "group long, name long, segment long, key long, first int, crowded boolean, settled boolean, bytes binary"


def compared(pieces: DataFrame, length: int) -> DataFrame:
    """Windows that repeat among different segments of a name.

    pieces: rows of PIECE, sorted by group within partitions; a group is a name, or a
    single segment of a crowded name. Gives runs (key, first, last, the rest null); the
    segments of crowded names are passed on, with their bytes, and piece = group.
    """
    schema = "key long, first int, last int, piece long, settled boolean, bytes binary"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["key", "first", "last", "piece", "settled", "bytes"])

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list({(r[0], r[2]): r for r in rows}.values())
        open_ = [r for r in rows if not r[5]]
        out = [(key, first, None, group, settled, raw) for group, _, _, key, first, crowded, settled, raw in rows if crowded]
        if len(open_) > 1:
            widths = [len(r[7]) - length + 1 for r in open_]
            flags = repeated([r[7] for r in open_], widths, length, [r[6] for r in open_])
            for (_, _, _, key, first, _, settled, _), flag in zip(open_, flags):
                if not settled:
                    out += [(key, first + a, first + b, None, None, None) for a, b in runs(flag)]
        for at in range(0, len(out), 5000):
            yield batch(out[at:at + 5000])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if size > BLOCK_BYTES and row[0] != group:
                    yield from solve(held)
                    held, size = [], 0
                group = row[0]
                held.append(row)
                size += len(row[7])
        if held:
            yield from solve(held)

    return pieces.mapInArrow(run, schema)


def fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (key, list of struct) as PIECE, once per task."""
    i64, i32, flag = pa.int64(), pa.int32(), pa.bool_()
    types = [i64, i64, i64, i64, i32, flag, flag, pa.binary()]
    names = ["group", "name", "segment", "key", "first", "crowded", "settled", "bytes"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for part in parts:
            out, size = [], 0
            ends = part.column(2).offsets.to_pylist()
            inner = part.column(2).flatten()
            lists_ = [inner.field(i).to_pylist() for i in range(7)]  # group, name, segment, first, last, crowded, settled
            for i, key in enumerate(part.column(0).to_pylist()):
                raw = None
                for j in range(ends[i] - ends[0], ends[i + 1] - ends[0]):
                    group, name, segment, first, last, crowded, settled = (c[j] for c in lists_)
                    if (name, segment) in seen:
                        continue
                    seen.add((name, segment))
                    raw = part.column(1)[i].as_py() if raw is None else raw
                    body = raw[first:last + length]
                    if len(body) == last + length - first:
                        out.append((group, name, segment, key, first, crowded, settled, body))
                        size += len(body)
                if size > BLOCK_BYTES:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    return texts.join(wanted, "key").select("key", "raw", "wanted").mapInArrow(run, PIECE)


def matched(texts: DataFrame, length: int, gram: int, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs (key, first, last) of repeated windows, and the segments of crowded names.

    texts: key, raw (bytes) and settled: such a text is met by others but asks nothing.
    words: the texts are read as the hashes of their words, if there are so many.
    """
    table = written(segment_table(texts, length, gram, words))
    inner = table.where("name is null and not settled").select("key", "first", "last").distinct()
    # a name that occurs once has nothing to meet; the join can deal hot names anew only if nothing is grouped in it
    often = written(table.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    table = written(table.join(often, "name", "left_semi").select(*table.columns))
    counts = table.groupBy("name", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("rep"), F.min("settled").alias("known"))
    # kinds: how many segments to compare; none if nothing is asked about a single one
    kinds = F.when(F.max(F.expr("n = 1 and not known")), F.count(F.lit(1))).otherwise(F.lit(1))
    names = counts.groupBy("name").agg(kinds.alias("kinds"))
    judged = counts.join(names, "name").where("n > 1 or kinds > 1").select("name", "segment", "n", "rep", "kinds")
    judged = written(table.join(judged, ["name", "segment"]).where("n > 1 or key = rep"))
    whole = judged.where("n > 1 and not settled").select("key", "first", "last").distinct()
    one = judged.where("kinds > 1 and key = rep").groupBy("key", "name", "segment", "kinds", "n").agg(
        F.min("first").alias("first"), F.min(F.expr("last - first")).alias("more"), F.min("settled").alias("known")
    )
    # in the last round a name is a window, and its segments differ in their number of windows alone
    crowded = F.col("kinds") > CROWDED if gram < length else F.lit(False)
    chosen = one.withColumn("last", F.col("first") + F.col("more")).select(
        "key",
        F.struct(
            F.when(crowded, F.xxhash64("name", "segment")).otherwise(F.col("name")).alias("group"), "name", "segment",
            "first", "last", crowded.alias("crowded"), (F.col("known") | (F.col("n") > 1)).alias("settled"),
        ).alias("w"),
    )
    wanted = chosen.groupBy("key").agg(F.collect_list("w").alias("wanted"))  # at most the segments of one text
    pieces = fetched(coded(texts, words) if words else texts, wanted, length)
    # no number given: few pieces, as in most rounds, are dealt to few tasks and leave few files
    found = written(compared(pieces.repartition("group").sortWithinPartitions("group"), length))
    spans = whole.union(inner).union(found.where("piece is null").select("key", "first", "last"))
    return spans, found.where("piece is not null").drop("last")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(key, spans): first and last start of the runs of repeated windows of each text.

    texts: key (a hash of the text) and raw (its bytes), one row per document. words: the
    texts are read as the hashes of their words, if there are so many.
    """
    gram = min(gram, length)
    rounds = sorted({gram, *(length - (length - gram) // d for d in (2, 4, 8)), length})
    spans, crowded = matched(texts.withColumn("settled", F.lit(False)), length, gram, words)
    place = None  # where in the documents the texts of a round are
    for gram in rounds[1:]:
        if crowded.isEmpty():
            break
        at = crowded.withColumnRenamed("first", "_at")
        if place is not None:
            outer = place.select(F.col("piece").alias("key"), F.col("key").alias("_key"), F.col("_at").alias("_more"))
            at = at.join(outer, "key").withColumns({"key": F.col("_key"), "_at": F.col("_at") + F.col("_more")})
        place = written(at.select("piece", "key", "_at"))
        again, crowded = matched(crowded.select(F.col("piece").alias("key"), F.col("bytes").alias("raw"), "settled"), length, gram)
        again = again.withColumnRenamed("key", "piece").join(place, "piece")
        spans = spans.union(again.select("key", F.expr("first + _at"), F.expr("last + _at")))
    return spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def word_borders(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end; they are split at ASCII blanks."""
    solid = np.concatenate([[False], ~SPACE[np.frombuffer(raw, np.uint8)], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def code_of(raw: bytes, words: int) -> bytes:
    """A hash of CODE bytes for every word; nothing if there are fewer than so many words."""
    starts, ends = word_borders(raw)
    if len(starts) < words:
        return b""
    return (hashed(np.frombuffer(raw, np.uint8), starts, ends) >> np.uint64(32)).astype("<u4").tobytes()


def coded(texts: DataFrame, words: int) -> DataFrame:
    """(key, raw) with a hash of CODE bytes for every word, of texts with so many words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, out = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                code = code_of(text.as_py(), words)
                if code:
                    keys.append(key)
                    out.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "raw"])

    return texts.mapInArrow(run, "key long, raw binary")


def word_spans(found: list[dict], words: int, raw: bytes) -> Iterator[tuple[int, int]]:
    """First byte, and the byte behind the last, of runs of windows of a coded text."""
    starts, ends = word_borders(raw)
    for s in found:
        low, high = -(-s["first"] // CODE), s["last"] // CODE  # windows that begin with a word
        if low <= high:
            yield int(starts[low]), int(ends[high + words - 1])


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
            length: int = LENGTH, gram: int = GRAM, as_text: bool = False, words: int | None = None) -> DataFrame:
    """key, the kept columns, n_bytes, n_removed, n_spans and `kept` (the remaining bytes).

    as_text: `kept` is a string; a character of which only a part is left is left out.
    words: strings of so many words that also start at another place are removed as well,
    whatever their bytes; the blanks between them may differ.

    Every byte covered by a string of `length` bytes that also starts at another place,
    in the same or another row, is removed. Null is the empty text; texts shorter than
    the length keep all; repeated rows count as copies of each other; a row with a null
    key is treated like any other; an empty table gives no rows.
    """
    names = list(dict.fromkeys((key, *keep)))
    if {"n_bytes", "n_removed", "n_spans", "kept", "_text", "_key", "_spans", "_words"} & set(names):
        raise ValueError("kept columns clash with the result's")
    base = docs.select(*names, whole_text(text).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    texts = base.select(F.col("_key").alias("key"), F.col("_text").cast("binary").alias("raw"))
    spans = written(repeats(texts.where(F.octet_length("raw") >= length), length, gram))
    joined = base.join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left")
    if words:
        least = CODE * words
        more = written(repeats(texts, least, max(CODE, least // 4), words))
        joined = joined.join(more.select(F.col("key").alias("_key"), F.col("spans").alias("_words")), "_key", "left")
    else:
        joined = joined.withColumn("_words", F.lit(None).cast(spans.schema["spans"].dataType))
    fields = [*docs.select(*names).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                rows = []
                for text, found, more in zip(*(some.column(len(names) + i) for i in range(3))):
                    raw = text.as_py().encode()
                    spans = [(s["first"], s["last"] + length) for s in found.as_py() or []]
                    if more.is_valid:
                        spans += word_spans(more.as_py(), words, raw)
                    if not spans:
                        rows.append((len(raw), 0, 0, text.as_py() if as_text else raw))
                        continue
                    cover = np.zeros(len(raw) + 1, np.int32)
                    for first, end in spans:
                        cover[first] += 1
                        cover[end] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((len(raw), int(gone.sum()), len(runs(gone)), kept.decode("utf-8", "ignore") if as_text else kept))
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:len(names)], *(pa.array(c, t) for c, t in zip(cols, types))],
                    [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select(*names, "_text", "_spans", "_words").mapInArrow(run, T.StructType(fields))
