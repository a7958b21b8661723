"""Ranked lexical search by hashed max-sketches.

A term's impact in a document is (10^9 tf) div (1000 tf + 12 m), where m grows with the
document's length against the mean. A document's impacts, those of all its terms, are
folded into WIDTH coordinates chosen by a hash of the term; a coordinate keeps the
maximum. A query term's impact is at most its coordinate's value, so the weighted sum
of the looked-up coordinates is an upper bound of the query's score, however terms
collide. A batch of documents is looked up for one query after the other; the documents
whose bound can still reach the query's k best are scored exactly in descending order
of their bounds, until a bound falls below the k-th best score (or ties with it at a
higher key). A task keeps the k best of every query over all its batches; the tasks'
lists are merged in two steps, so that no group grows with the table.

Queries are taken in blocks of at most BLOCK_BYTES of text, which is what a task's
closure holds; every block reads the documents twice: once for the number of documents
and terms and the document frequencies of its own terms, once for the ranking.

Defined cases: a null text has no terms, like an empty one; a query without terms and
a document without a common term give no row; equal scores go by ascending key, null
first; repeated documents are documents of their own; equal rows of the query table
are one query, rows that share an item but not the text are ranked apart; a query or
document table without rows gives none; other columns play no part.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .words import slices

TOP = 20
WIDTH = 4096  # coordinates of a sketch
BLOCK_BYTES = 4_000_000  # of query text at once
BATCH = 256  # documents looked up at once
CHUNK = 32  # candidates scored at once
UNIT = 1_000_000_000
MAX_TERMS, MAX_TERM_BYTES = 300_000, 30_000_000  # a task forgets its terms beyond these

# Fixed: terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are folded.
FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms in order, as UTF-8; bytes beyond ASCII never separate."""
    return text.encode().translate(FOLD).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def statistics(df: DataFrame, text: str, vocabulary: list[bytes]) -> tuple[int, int, list[int]]:
    """Documents with a term, terms of all documents, documents holding each vocabulary term."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(vocabulary)
        holding: Counter = Counter()
        documents = total = 0
        for part in parts:
            for _, texts in slices(part.column(0)):
                for value in texts:
                    found = terms_of(value)
                    documents += bool(found)
                    total += len(found)
                    holding.update(known.intersection(found))
        at = [i for i, t in enumerate(vocabulary) if t in holding]
        counts = [holding[vocabulary[i]] for i in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *at], pa.int64()), pa.array([documents, total, *counts], pa.int64())], ["term", "n"])

    rows = df.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r["term"]: r["n"] for r in rows}
    return sums.get(-2, 0), sums.get(-1, 0), [sums.get(i, 0) for i in range(len(vocabulary))]


class Batch:
    """Documents of one batch: sketch coordinates that queries look up, exact impacts."""

    def __init__(self, count: int, at: np.ndarray, number: np.ndarray, impact: np.ndarray,
                 slot: np.ndarray, word: np.ndarray, slots: int, words: int):
        """at, number, impact: document, term and impact; slot, word: a term's looked-up coordinate and vocabulary number."""
        self.sketch = np.zeros((slots, count), np.int64)
        seen = slot[number] >= 0
        np.maximum.at(self.sketch, (slot[number[seen]], at[seen]), impact[seen])
        asked = word[number] >= 0
        key = at[asked] * words + word[number[asked]]
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.impact = np.append(impact[asked][order], 0)
        self.words = words

    def bounds(self, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return weights @ self.sketch[slots]

    def scores(self, docs: np.ndarray, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        key = docs[:, None] * self.words + words
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.impact[at], 0) @ weights


def best_of(df: DataFrame, key: str, text: str, queries: list[list[tuple[int, int]]], vocabulary: list[bytes],
            documents: int, total: int, top: int, width: int) -> DataFrame:
    """(query, slice, <key>, score): every task's k best documents of every query.

    queries: (vocabulary number, weight times repeats) of each query's terms.
    """
    lists = [(np.array([t for t, _ in q], np.int64), np.array([w for _, w in q], np.int64)) for q in queries]
    coordinate = np.array([crc32(t) % width for t in vocabulary], np.int64)
    looked, column = np.unique(coordinate, return_inverse=True)
    slot_of = np.full(width, -1, np.int64)
    slot_of[looked] = np.arange(len(looked))
    key_type = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_of = {t: i for i, t in enumerate(vocabulary)}
        best: list[list[tuple]] = [[] for _ in lists]  # (-score, key is not null, key), ascending
        numbers: dict[bytes, int] = {}
        slot, word, held = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def number(found: list[bytes]) -> list[int]:
            """Numbers of terms; new ones get their coordinate and vocabulary number."""
            nonlocal slot, word, held
            if len(numbers) > MAX_TERMS or held > MAX_TERM_BYTES:
                numbers.clear()
                slot, word, held = slot[:0], word[:0], 0
            fresh = [t for t in dict.fromkeys(found) if t not in numbers]
            if fresh:
                numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
                held += sum(map(len, fresh))
                slot = np.append(slot, slot_of[[crc32(t) % width for t in fresh]])
                word = np.append(word, [word_of.get(t, -1) for t in fresh])
            return [numbers[t] for t in found]

        def rank(keys: list, texts: list[str]) -> None:
            found = [terms_of(t) for t in texts]
            sizes = np.array([len(f) for f in found], np.int64)
            flat = np.array(number([t for f in found for t in f]), np.int64)
            if not len(flat):
                return
            pair, tf = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(numbers) + flat, return_counts=True)
            at, term = np.divmod(pair, len(numbers))
            longer = np.array([100 - 25 + 25 * int(n) * documents // total for n in sizes], np.int64)
            impact = UNIT * tf // (1000 * tf + 12 * longer[at])
            batch = Batch(len(texts), at, term, impact, slot, word, len(looked), len(vocabulary))
            order_keys = [(k is not None, 0 if k is None else k) for k in keys]
            for (words, weights), own in zip(lists, best):
                bound = batch.bounds(column[words], weights)
                likely = np.flatnonzero(bound >= (-own[-1][0] if len(own) == top else 1))
                if not len(likely):
                    continue
                likely = likely[np.argsort(-bound[likely], kind="stable")]
                for low in range(0, len(likely), CHUNK):
                    docs = likely[low:low + CHUNK]
                    if len(own) == top and bound[docs[0]] < -own[-1][0]:
                        break
                    for d, score in zip(docs.tolist(), batch.scores(docs, words, weights).tolist()):
                        entry = (-score, *order_keys[d])
                        if score > 0 and (len(own) < top or entry < own[-1]):
                            insort(own, entry)
                            del own[top:]

        for part in parts:
            ids = part.column(0).to_pylist()
            for start, texts in slices(part.column(1)):
                for low in range(0, len(texts), BATCH):
                    some = texts[low:low + BATCH]
                    rank(ids[start + low:start + low + len(some)], some)
        out = [(q, k if there else None, -s) for q, own in enumerate(best) for s, there, k in own]
        if out:
            at, docs, scores = zip(*out)
            kind = part.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array(docs, kind), pa.array(scores, pa.int64())], ["query", key, "score"])

    found = df.select(key, text).mapInArrow(run, f"query long, `{key}` {key_type}, score long")
    return found.withColumn("slice", F.spark_partition_id() % 1024)


def search(df: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
           item: str = "item_id", query: str = "text", width: int = WIDTH) -> DataFrame:
    """item, rank, key, score: the best documents of every query, highest score first."""
    asked = items.select(F.col(item).alias("item"), F.col(query).alias("words")).where("words IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    item_type = items.schema[item].dataType.simpleString()
    result = None
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == number).collect()
        counted = [Counter(terms_of(r["words"])) for r in rows]
        vocabulary = sorted({t for c in counted for t in c})
        documents, total, frequency = statistics(df, text, vocabulary)
        place = {t: i for i, t in enumerate(vocabulary)}
        weights = [weight(documents, f) for f in frequency]
        queries = [[(place[t], n * weights[place[t]]) for t, n in c.items() if frequency[place[t]]] for c in counted]
        found = best_of(df, key, text, queries, vocabulary, documents, total, top, width)
        ranking = [F.col("score").desc(), F.col(key).asc_nulls_first()]
        for group in (["query", "slice"], ["query"]):
            order = Window.partitionBy(*group).orderBy(*ranking)
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = df.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"query long, `{item}` {item_type}")
        found = found.join(names, "query").select(item, "rank", key, "score")
        result = found if result is None else result.union(found)
    if result is None:
        empty = f"`{item}` {item_type}, rank int, `{key}` {df.schema[key].dataType.simpleString()}, score long"
        return df.sparkSession.createDataFrame([], empty)
    return result


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM len),
q AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id,
    sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), tot GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 20
"""
