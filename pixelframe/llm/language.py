"""Language of a text: family first, then one-versus-one support vector machines.

A text is a unit vector of square-rooted frequencies of hashed byte pairs and triples of
its lower-cased letters. A linear support vector machine per family (one versus the
rest) picks the family; inside it, machines for each pair of its languages vote, ties
going to the larger sum of margins. All machines minimise the squared hinge loss on a
bounded sample of labelled rows of each language.

Defined cases: a null text, or one without a letter, is `und` with score 0; texts are
read whole; repeated rows give repeated rows; without labelled rows all are `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import held_out

SAMPLE = 800  # labelled rows of each language, taken by a hash of their text
SAMPLE_CHARS = 20_000  # longer labelled texts are not learnt from
MOST_LANGUAGES = 200  # different labels in the training rows
SIZE = 2048
WORDY = re.compile(r"[^\W\d_]")  # letters, and numerals that are no digits


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORDY.finditer(text))


# Families of languages by their codes; fixed values. Others are families of one.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"), "celtic": ("br", "cy", "ga", "gd"), "uralic": ("et", "fi", "hu"),
    "iranian": ("fa", "ku", "ps", "tg"), "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "uz"), "semitic": ("am", "ar", "he", "mt"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def vector(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int64)
    # anything that isn't a letter is one blank
    raw = np.where((raw >= 97) & (raw <= 122) | (raw >= 128), raw, 32)
    raw = np.concatenate([[32], raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])], [32]])
    pairs = (raw[:-1] << 8 | raw[1:]) * 0x9E3779B1
    triples = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * 0x85EBCA6B + 0x27D4EB2F
    counts = np.bincount(np.concatenate([pairs, triples]) >> 13 & (SIZE - 1), minlength=SIZE)
    out = np.sqrt(counts.astype(float))
    return out / max(1e-12, np.linalg.norm(out))


def machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; y is +1 or -1."""
    x = np.column_stack([x, np.ones(len(x))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # classes weigh alike
    w = v = np.zeros(x.shape[1])
    rate = 1 / (2 * 2 + ridge)
    for i in range(steps):  # accelerated gradient; rows have length 2 at most
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v + rate * (2 * x.T @ (share * y * slack) - ridge * v)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    coarse: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE + 1)))
    fine: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            name, score = "und", 0.0
            if text and self.families and has_letter(text):
                x = np.append(vector(text), 1.0)
                margins = self.coarse @ x
                at = int(np.argmax(margins))
                rest = np.delete(margins, at)
                sure = [margins[at] - rest.max()] if len(rest) else [10.0]
                langs = self.members[self.families[at]]
                name = langs[0]
                if len(langs) > 1:
                    votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
                    for (a, b), w in ((p, w) for p, w in self.fine.items() if p[0] in votes):
                        m = float(w @ x)
                        votes[a if m >= 0 else b] += 1
                        sums[a] += m
                        sums[b] -= m
                    order = sorted(langs, key=lambda n: (-votes[n], -sums[n], n))
                    name = order[0]
                    sure.append(min(abs(float(w @ x)) for (a, b), w in self.fine.items() if name in (a, b)))
                score = float(np.prod([1 / (1 + np.exp(-4 * s)) for s in sure]))
            names.append(name)
            scores.append(score)
        return names, scores


def fit(texts: list[str], langs: list[str]) -> Model:
    if not texts:
        return Model()
    x, y = np.stack([vector(t) for t in texts]), np.array(langs)
    family = np.array([FAMILY_OF.get(n, n) for n in langs])
    model = Model(families=sorted(set(family.tolist())))
    model.coarse = np.stack([
        machine(x, np.where(family == f, 1.0, -1.0)) if len(model.families) > 1 else np.zeros(SIZE + 1) for f in model.families])
    for f in model.families:
        names = model.members[f] = sorted(set(y[family == f].tolist()))
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                rows = (y == a) | (y == b)
                model.fine[a, b] = machine(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    return model


def learn(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from at most `sample` rows of each language that are not held out."""
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}") & (F.length(text) <= SAMPLE_CHARS))
    order = F.xxhash64(text, lang)
    # different texts, so that copies don't thin out the others of their language
    counts = known.groupBy(lang).agg(F.approx_count_distinct(order).alias("n")).orderBy(lang).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # a hash share of each language, a little above the sample, then exactly the sample
    near = F.lit(False)
    for r in counts:
        near = near | ((F.col(lang) == r[0]) & (F.pmod(order, F.lit(max(1, r["n"] // (2 * sample)))) == 0))
    few = known.where(near).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), order.alias("_order")).distinct()
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_text"))
    rows = few.withColumn("_n", place).where(F.col("_n") <= sample).orderBy("_lang", "_n").collect()
    return fit([r["_text"] for r in rows], [r["_lang"] for r in rows])


def predict(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every whole text."""
    names = list(keep)
    if {"lang_pred", "score"} & set(names):
        raise ValueError("kept columns may not be called lang_pred or score")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                langs, scores = model.predict(some.column(some.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*some.select(names).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*names, "lang_pred", "score"])

    fields = [*df.select(*names).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return df.select(*dict.fromkeys([*names, text])).mapInArrow(run, T.StructType(fields))
