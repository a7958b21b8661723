"""Max-sketch search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pixelframe.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, score long, rank string, item_id string, slice int"
ITEMS = "item_id long, text string, doc_id string, score string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    counts = [(k, Counter(terms(t))) for k, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, query in set(items):
        found = []
        for k, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(query) if c[t])
            if score > 0:
                found.append((-score, k is not None, k or 0, k))
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items, parts=3):
    return (spark.createDataFrame([(k, t, 7, "r", "i", 1) for k, t in docs], DOCS).repartition(parts),
            spark.createDataFrame([(k, t, "d", "s") for k, t in items], ITEMS))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß1") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(700)]
    docs += [(2000 - i, "The Same copy, " + words[3]) for i in range(150)] + [(None, words[5] + " null"), (9, None), (10, "")]
    docs += [(5000, text(30_000)), (5001, "İı \x00-_ÄÄ x\x7fy"), (5002, "...!?"), (3, docs[3][1]), (3, docs[3][1])]
    items = [(i, text(rng.randint(1, 40))) for i in range(40)] + [(90, "same COPY the the"), (91, None), (92, ""), (93, "nowhere!")]
    return docs, items + [(90, "same COPY the the"), (94, "null x ää İı"), (95, "%"), (0, words[7])]


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_against_all_scores(spark, corpus, width):
    """A narrow sketch collides everywhere; its bounds stay bounds."""
    docs, items = corpus
    got = lexical.search(*tables(spark, docs, items), width=width).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_blocks_of_queries_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 3000)
    got = lexical.search(*tables(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    for d, i in ((docs, []), ([], items), ([], [])):
        found = lexical.search(*tables(spark, d, i))
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_bounds_are_bounds_and_few_documents_are_scored(monkeypatch):
    rng = np.random.default_rng(2)
    docs, words = 64, 500
    at, number = np.nonzero(rng.random((docs, words)) < 0.2)
    impact = rng.integers(1, 1_000_000, len(at))
    slot = rng.integers(-1, 40, words)
    word = np.where(slot >= 0, np.arange(words), -1)
    batch = lexical.Batch(docs, at, number, impact, slot, word, 40, words)
    full = np.zeros((docs, words), np.int64)
    full[at, number] = impact
    asked = np.flatnonzero(word >= 0)[:30]
    weights = rng.integers(1, 9000, len(asked))
    scores = batch.scores(np.arange(docs), asked, weights)
    assert (scores == full[:, asked] @ weights).all()
    assert (batch.bounds(slot[asked], weights) >= scores).all()
