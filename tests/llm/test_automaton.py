"""Repeated windows against brute force; the automaton against scanning."""

import hashlib
import random
import re

import numpy as np
import pytest

from pixelframe.llm import automaton

SCHEMA = "doc_id long, text string, doc string, tag string, name int, first int"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain(rows, width=13):
    """Every window's smallest document by a dictionary of all windows."""
    number = lambda k: 1 << 70 if k is None else k
    least = {}
    for k, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            own = tuple(w[i:i + width])
            least[own] = min(least.get(own, 1 << 71), number(k))
    out = []
    for k, text in rows:
        w = words(text)
        drop = [False] * len(w)
        for i in range(len(w) - width + 1):
            if least[tuple(w[i:i + width])] < number(k):
                drop[i:i + width] = [True] * width
        spans = sum(d and not (i and drop[i - 1]) for i, d in enumerate(drop))
        kept = " ".join(x for x, d in zip(w, drop) if not d)
        out.append((k, len(w), sum(drop), spans, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    body = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [body(n) for n in (12, 13, 14, 25, 60, 13)]
    out = [(i, body(rng.randint(0, 40)) + " " + rng.choice(passages) + "\t" + body(rng.randint(0, 40))) for i in range(150)]
    out += [(500 + i, body(3) + "\n" + passages[4] + "  " + body(2)) for i in range(60)]
    base = body(90).split()
    for i in range(40):  # near copies
        own = list(base)
        own[rng.randrange(90)] = rng.choice(vocabulary)
        out.append((700 + i, " ".join(own)))
    out += [(800 + i, " ".join(base)) for i in range(30)] + [(3000, "ring " * 50), (2000, "ring " * 13), (2001, "ring " * 12)]
    out += [(20, None), (21, ""), (22, " \n\t "), (None, " ".join(base)), (None, passages[3]), (900, "x\x0bé " * 20)]
    out += [(700, "another text under a used key " + passages[4]), (5, out[5][1]), (5, out[5][1]), (-4, passages[2])]
    return out + [(9999, body(20_000) + " " + passages[4] + " " + " ".join(base)), (9998, "a" * 50_000)]


@pytest.mark.parametrize("crowd", [512, 2])
def test_against_brute_force(spark, rows, crowd):
    df = spark.createDataFrame([(k, t, "d", "t", 1, 2) for k, t in rows], SCHEMA).repartition(4)
    got = automaton.removed(df, crowd=crowd).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert sum(r.n_removed for r in got) > 3000


def test_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, "own  words\n" + text + " end")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in automaton.removed(df, as_text=True).collect()} == {1: text, 2: "own words end"}


def test_empty(spark):
    assert automaton.removed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_row_a_copy(spark):
    """A hot passage of many documents reaches the shards once."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = automaton.base(spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string"), "doc_id", "text")
    found = automaton.occurrences(docs, names_only=False)
    assert found.select("name", "digest").distinct().count() * 300 == found.count()


def test_statistics_against_scanning():
    rng = random.Random(1)
    for _ in range(60):
        texts = [([rng.choice("abc") for _ in range(rng.randint(0, 14))], rng.randint(0, 9)) for _ in range(rng.randint(1, 5))]
        built = automaton.Automaton()
        for text, document in texts:
            built.add(text, document)
        built.finish()
        asked = [rng.choice("abcd") for _ in range(25)]

        def holding(part):
            return [d for t, d in texts if any(t[i:i + len(part)] == part for i in range(len(t) - len(part) + 1))]

        for end, (length, first) in enumerate(built.statistics(asked, 3), 1):
            longest = max(n for n in range(end + 1) if n == 0 or holding(asked[end - n:end]))
            assert length == longest
            assert first == (min(holding(asked[end - 3:end])) if longest >= 3 else automaton.LAST)


def test_passages_hold_every_window_once():
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 9, n))) for n in (0, 5, 13, 14, 200, 12, 77)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    text, name, digest, pos, n = automaton.passages(raw, np.cumsum([0, *map(len, texts)]))
    covered = sorted((t, p + i) for t, p, k in zip(text, pos, n) for i in range(k))
    assert covered == [(t, i) for t, s in enumerate(texts) for i in range(len(s.split()) - 12)]
    assert n.max() <= 10


def test_hashes_depend_on_the_word_alone():
    own = ["a", "b", "ab", "ba", "é", "x" * 64, "x" * 65, "x" * 66, "y" * 300, "a"]
    raw = np.frombuffer(" ".join(own).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in own]) - 1
    found = automaton.hashed(raw, np.append(0, ends[:-1] + 1), ends)
    assert found[0] == found[-1] and len(set(found.tolist())) == len(own) - 1
    again = automaton.hashed(raw, ends[4:6] + 1, ends[5:7])
    assert (again == found[5:7]).all()
