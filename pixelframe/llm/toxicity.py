"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

From a bounded sample of labelled rows a dictionary is trained on ordinary windows, and
another on the toxic text: on those of its words that hold byte pieces far more frequent
in toxic documents. The toxic side compresses with its own dictionary laid in front of
the ordinary one, so ordinary text costs the same bytes on both sides and a window's
difference shows what only the toxic dictionary knows. Each number of saved bytes has a
log likelihood ratio; their sum over a document's windows, its mean and its scaled sum
go through a logistic curve, and 0.5 is the threshold. Ratios and curve are calibrated
on differences measured with toxic dictionaries that haven't seen the document (folds).

Defined cases: null is the empty text, which has no windows and gets the score of zero
features; texts are read whole; repeated rows give repeated rows; an empty table gives
none; without labelled rows of both classes every score is the share of toxic labels
(0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import held_out
from .words import slices

SAMPLE = 2000  # labelled rows of each class, taken by a hash of their key
SAMPLE_CHARS = 20_000  # longer labelled texts are not learnt from
WINDOW = 96  # bytes, ended at a blank
GRAM = 6
OVERSHOOT = 7.0  # z value from which a byte piece counts as toxic
ORDINARY_BYTES, TOXIC_BYTES = 64_000, 8_192
BINS = 8  # saved bytes of a window: below zero, 0, 1, ..., 6 and more
FOLDS = 4


def windows(text: str) -> list[bytes]:
    raw = text.lower().encode().translate(bytes.maketrans(b"\n\t\r", b"   "))
    out, at = [], 0
    while at < len(raw):
        stop = raw.find(b" ", at + WINDOW, at + WINDOW + 40) if at + WINDOW < len(raw) else len(raw)
        stop = at + WINDOW if stop < 0 else stop
        out.append(b" " + raw[at:stop] + b" ")
        at = stop + (raw[stop:stop + 1] == b" ")
    return out


def grams_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words in a row with single blanks around, and the byte pieces inside one word
    (its blanks included) as numbers, with their places."""
    raw = b" " + b" ".join(text.lower().encode().split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.int64)
    n = len(a) - GRAM + 1
    if n < 1:
        return raw, np.empty(0, np.int64), np.empty(0, np.int64)
    value, broken = a[:n].copy(), np.zeros(n, bool)
    for i in range(1, GRAM):
        value = value << 8 | a[i:n + i]
        if i < GRAM - 1:
            broken |= a[i:n + i] == 32
    place = np.flatnonzero(~broken)
    return raw, value[place], place


def overshoot(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """Byte pieces far more frequent in toxic than in ordinary documents."""
    m, n = len(toxic), len(ordinary)
    grams, a = np.unique(np.concatenate(toxic), return_counts=True)
    other, count = np.unique(np.concatenate(ordinary), return_counts=True)
    grams, a = grams[a >= 3], a[a >= 3]
    at = np.minimum(np.searchsorted(other, grams), max(0, len(other) - 1))
    b = np.where(other[at] == grams, count[at], 0) if len(other) else np.zeros(len(grams))
    pool = (a + b) / (m + n)
    z = (a / m - b / n) / np.maximum(1e-9, np.sqrt(pool * (1 - pool) * (1 / m + 1 / n)))
    bar = min(OVERSHOOT, max(2.0, 0.6 * (m * n / (m + n)) ** 0.5))  # what small samples can show
    return grams[z >= bar]


def loud_words(text: str, marks: np.ndarray) -> list[bytes]:
    """The words, blanks around them included, that hold one of the pieces."""
    raw, values, places = grams_of(text)
    blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    words = np.unique(np.searchsorted(blanks, places[np.isin(values, marks)], "right") - 1)
    return [raw[blanks[k]:blanks[k + 1] + 1] for k in words.tolist()]


def dictionary(samples: list[bytes], size: int, **cover: int) -> bytes:
    """Content of a trained dictionary; of too few samples the different ones in a row."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(BINS))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    scale: np.ndarray = field(default_factory=lambda: np.ones(5))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    prior: float | None = None

    def saved(self):
        """A function from a window to the bytes that the toxic dictionary saves."""
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=17, chain_log=17, hash_log=17, search_log=6, min_match=5, target_length=64,
            strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        sides = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            sides.append(z.ZstdCompressor(compression_params=params, dict_data=d).compress)
        plain, toxic = sides
        return lambda w: len(plain(w)) - len(toxic(w))

    def histograms(self, texts: list[str]) -> np.ndarray:
        """How many windows of each text save how many bytes."""
        saved = self.saved()
        rows = [np.bincount(np.clip([saved(w) for w in windows(t)], -1, BINS - 2).astype(int) + 1, minlength=BINS)
                if t else np.zeros(BINS, int) for t in texts]
        return np.array(rows, float).reshape(-1, BINS)

    def features(self, counts: np.ndarray) -> np.ndarray:
        n, total = counts.sum(axis=1), counts @ self.ratios
        return np.column_stack([np.clip(total, -15, 15), total / np.sqrt(n + 3), total / (n + 3), np.log1p(n),
                                counts[:, 4:].sum(axis=1) / (n + 3)])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        if "saved" not in vars(self):
            ready = self.saved()
            self.saved = lambda: ready  # one pair of compressors per task
        x = (self.features(self.histograms(texts)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def toxic_dictionary(toxic: list[str], grams: list[np.ndarray], ordinary: list[np.ndarray]) -> bytes:
    marks = overshoot(grams, ordinary)
    loud = [w for t in toxic for w in loud_words(t, marks)]
    loud = loud or [w for t in toxic for w in windows(t)] or [b" "]
    # pieces of 6 bytes, so that short words count, in stretches of 32
    return dictionary(loud * max(1, 4000 // len(loud)), TOXIC_BYTES, d=GRAM, k=32)


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model:
    """Dictionaries and the calibrated curve from labelled texts.

    odds: toxic to ordinary among all labels, where the sample has other shares.
    """
    if len(toxic) < FOLDS or len(ordinary) < FOLDS:
        n = len(toxic) + len(ordinary)
        return Model(prior=len(toxic) / n if n else 0.0)
    loud, calm = ([np.unique(grams_of(t)[1]) for t in texts] for texts in (toxic, ordinary))
    common = dictionary([w for t in ordinary for w in windows(t)][:200_000] or [b" "], ORDINARY_BYTES)
    xs, ys = [], []
    for k in range(FOLDS):
        rest = [i for i in range(len(toxic)) if i % FOLDS != k]
        part = Model(common, toxic_dictionary([toxic[i] for i in rest], [loud[i] for i in rest],
                                              [g for i, g in enumerate(calm) if i % FOLDS != k]))
        for texts, label in ((toxic[k::FOLDS], 1.0), (ordinary[k::FOLDS], 0.0)):
            xs.append(part.histograms(texts))
            ys.append(np.full(len(texts), label))
    counts, y = np.concatenate(xs), np.concatenate(ys)
    model = Model(common, toxic_dictionary(toxic, loud, calm))
    n = np.maximum(1, counts.sum(axis=1, keepdims=True))
    shares = counts / n * np.minimum(n, 20)  # long documents don't dominate
    likely = [(shares[y == v].sum(axis=0) / max(1, shares[y == v].sum())) + 1e-3 for v in (1, 0)]
    model.ratios = np.log(likely[0] / likely[1])
    x = model.features(counts)
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
    if odds:
        w[0] += np.log(odds * len(ordinary) / len(toxic))
    model.weights = w
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """A model from at most `sample` labelled rows of each class that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(key).agg(F.max(label).alias("_label"))
    order = F.xxhash64(key)
    ids = known.where("_label = 1").orderBy(order, key).limit(sample).union(
        known.where("_label = 0").orderBy(order, key).limit(sample))
    rows = docs.where(F.length(text) <= SAMPLE_CHARS).join(F.broadcast(ids), key)  # at most 2 x sample ids
    rows = rows.groupBy(key, "_label").agg(F.min(text).alias("_text")).orderBy(F.xxhash64(key), key)
    texts = rows.select("_label", "_text").collect()
    share = known.agg(F.avg("_label")).first()[0]
    odds = share / (1 - share) if share and share < 1 else None
    return fit([r[1] for r in texts if r[0] == 1], [r[1] for r in texts if r[0] == 0], odds)


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from 0.5) of every whole text."""
    names = list(keep)
    if {"score", "predicted"} & set(names):
        raise ValueError("kept columns may not be called score or predicted")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, texts in slices(part.column(part.schema.get_field_index(text))):
                found = model.scores(texts)
                rest = part.select(names).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    fields = [*df.select(*names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType(fields))
