"""SimHash, suffix sorting, sketches and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelframe.llm import graph, neighbours, queries, resemblance, simhash, sketch, suffix

SCHEMA = "doc_id long, text string, component_id string, n_bytes string, print string, spans string"


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "a", "b", "c", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    body = lambda n: " ".join(word() for _ in range(n))
    shared, base = body(120), body(200).split()
    out = [None, "", " \n\t", "One", "one", "ONE two", body(300), "ä Ä é É " * 40]
    out += [body(30) + " " + shared + " " + body(30) for _ in range(6)]
    for i in range(40):
        near = list(base)
        near[i % 7] = word()
        out.append(" ".join(near))
    out += [" ".join(base)] * 5 + ["ring " * 400, "over and over again\n" * 60, "x" * 3000]
    return out


def fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """Smallest key reachable by links of two or fewer bits."""
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            a, b = find(k), find(keys[j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_golay_code():
    assert (simhash.LEADERS >= 0).all()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for flips in (0, 1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        a, b = simhash.golay_keys(words), simhash.golay_keys(other)
        for x, y in zip(a, b):
            assert set(x[x >= 0]) & set(y[y >= 0])
            assert 1 <= (x >= 0).sum() <= 6


@pytest.mark.parametrize("dense", [2, 64])
def test_links_of_close_fingerprints(spark, dense):
    rng = random.Random(2)
    centre, prints = rng.getrandbits(64), {}
    for i in range(150):
        value = centre if i < 100 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            value ^= 1 << rng.randrange(64)
        prints[value - (1 << 64) * (value >> 63)] = value
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r.node: r.component for r in graph.components(simhash.links(df, dense=dense)).collect()}
    want = grouped(prints)
    groups = lambda of: sorted(sorted(k for k in prints if of(k) == g) for g in {of(k) for k in prints})
    assert groups(lambda k: found.get(k, k)) == groups(want.get)


def test_near_duplicates(spark, texts):
    rows = simhash.near_duplicates(table(spark, texts)).collect()
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = grouped(prints)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_near_duplicates_null_keys_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "lonely words here now")], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 4
    assert sorted(str((r.doc_id, r.component_id)) for r in rows) == ["(7, 7)", "(7, 7)", "(None, 7)", "(None, None)"]
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.text for r in kept)) == ["a b c d", "lonely words here now"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each(spark, texts):
    kept = {r.doc_id for r in simhash.one_of_each(table(spark, texts)).collect()}
    assert kept == set(grouped({i: fingerprint(t) for i, t in enumerate(texts)}).values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert len(found) == 201 + 300
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + i] == 1000 for i in range(300))


# --- repeated passages -----------------------------------------------------------


def cut(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((len(b), int(gone.sum()), len(suffix.runs(gone)), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length,gram,crowd", [(400, 100, 1000), (400, 100, 1), (30, 8, 2), (12, 12, 1000), (12, 12, 1)])
def test_removed_bytes(spark, texts, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(suffix, "CROWDED", crowd)
    rows = suffix.removed(table(spark, texts), length=length, gram=gram).collect()
    want = cut(texts, length)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], texts[r.doc_id]


@pytest.mark.parametrize("passage", [120, 260, 399, 401, 650])
def test_crowded_passage(spark, monkeypatch, passage):
    """A passage just below or above 400 bytes in all texts, each with its own surroundings."""
    rng = random.Random(passage)
    body = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = body(passage)
    same = [body(rng.randint(0, 500)) + shared + body(rng.randint(0, 500)) for _ in range(40)]
    same += same[:3] + [body(9) + same[4][-300:] + body(500), shared * 3]
    rows = {}
    for crowd in (2, 1000):
        monkeypatch.setattr(suffix, "CROWDED", crowd)
        rows[crowd] = suffix.removed(table(spark, same)).collect()
        want = cut(same, 400)
        for r in rows[crowd]:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_removed_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = dict(zip(docs, cut(docs.values(), 400)))
    rows = queries.QUERIES["op6_suffix_dedup"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_removed_edges(spark):
    df = spark.createDataFrame([(1, "é" * 300), (1, "é" * 300), (None, None), (2, "abc")], "doc_id long, text string")
    rows = suffix.removed(df, as_text=True).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (3, 0), (600, 600), (600, 600)]
    assert suffix.removed(df.limit(0)).count() == 0


def cut_words(texts, length, words):
    """Kept bytes where strings of bytes, and strings of words, go."""
    raw = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raw]
    seen = {}
    for b, at in zip(raw, places):
        for own in [b[i:i + length] for i in range(len(b) - length + 1)]:
            seen[own] = seen.get(own, 0) + 1
        for i in range(len(at) - words + 1):
            own = tuple(b[x:y] for x, y in at[i:i + words])
            seen[own] = seen.get(own, 0) + 1
    out = []
    for b, at in zip(raw, places):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            gone[i:i + length] |= seen[b[i:i + length]] > 1
        for i in range(len(at) - words + 1):
            if seen[tuple(b[x:y] for x, y in at[i:i + words])] > 1:
                gone[at[i][0]:at[i + words - 1][1]] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("length,gram,words,crowd", [(400, 100, 51, 2), (30, 8, 1, 1000)])
def test_passages_of_words(spark, texts, monkeypatch, length, gram, words, crowd):
    """Strings of words go as well, whatever their bytes and the blanks between them."""
    monkeypatch.setattr(suffix, "CROWDED", crowd)
    rng = random.Random(5)
    body = lambda n: [rng.choice("abcdefgh") + rng.choice("é xyz").strip() for _ in range(n)]
    shared = body(53)
    more = [" ".join(body(rng.randint(0, 30)) + shared[:n]) + "\n\t" + "  ".join(body(rng.randint(0, 30))) for n in (49, 50, 51, 52, 53) for _ in range(4)]
    more += [" ".join(body(9)) + " " + "\n".join(shared), " ".join(shared[:10] * 6), "", None, " ", "one"]
    rows = suffix.removed(table(spark, texts + more), length=length, gram=gram, words=words).collect()
    want = cut_words(texts + more, length, words)
    assert len(rows) == len(want)
    for r in rows:
        assert bytes(r.kept) == want[r.doc_id] and r.n_removed == r.n_bytes - len(want[r.doc_id])


def test_pipeline_cuts_short_words(spark):
    """A passage of 51 words with fewer than 400 bytes that two documents share goes, one of 50 stays."""
    import corpus_pipeline

    own = [f"{i}" for i in range(500)]
    text = {1: own[:51] + ["a"], 2: ["b"] + own[:51], 3: own[100:150] + ["c"], 4: ["d"] + own[100:150]}
    docs = spark.createDataFrame([(k, " ".join(t), "en", "web", 0) for k, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeated_passages(spark, docs, None).collect()}
    assert found == {1: (" a", 2), 2: ("b ", 2), 3: (" ".join(text[3]), 0), 4: (" ".join(text[4]), 0)}


def test_suffix_order():
    rng = random.Random(1)
    for trial in range(200):
        letters = b"ab" if trial % 2 else b"abcdef"
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 6))]
        pieces.append(rng.choice(pieces)[:10])
        flags = suffix.repeated(pieces, [len(p) - 7 for p in pieces], 8)
        seen = [p[i:i + 8] for p in pieces for i in range(len(p) - 7)]
        for p, f in zip(pieces, flags):
            assert f.tolist() == [seen.count(p[i:i + 8]) > 1 for i in range(len(p) - 7)]
        data, base = b"".join(pieces), np.cumsum([0, *map(len, pieces)])
        starts = np.concatenate([np.arange(b, b + len(p) - 7) for b, p in zip(base, pieces)])
        order = suffix.sort_windows(data, starts, np.append(np.diff(starts) != 1, True), 8)
        assert [data[i:i + 8] for i in order] == sorted(seen)


def test_windows_in_order_hold_little_memory():
    """Whole windows are copied a part at a time, not all of a block."""
    import tracemalloc

    rng = np.random.default_rng(3)
    data = rng.integers(97, 117, 120_000, dtype=np.uint8).tobytes()
    starts = np.arange(len(data) - 399)
    tracemalloc.start()
    order = suffix.sort_windows(data, starts, starts == starts[-1], 400)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24e6 and sorted(order.tolist()) == starts.tolist()
    assert all(data[a:a + 400] <= data[b:b + 400] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))


def test_words_are_coded_where_segments_are_found(spark, texts, monkeypatch):
    """Two Python steps in a row would be two Python processes for each task."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(suffix, "written", seen)
    suffix.repeats(table(spark, texts).selectExpr("doc_id AS key", "cast(coalesce(text, '') AS binary) AS raw"), 204, 51, words=51)
    assert plans[0].count("MapInArrow") == 1


# --- sketches ----------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(spark, texts):
    rows = {r.doc_id: r for r in sketch.compare_with_edit(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    wrong = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(t) // 4
        edited = t[:len(t) - quarter] + after[:quarter]
        r = rows[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, want, n in ((r.near_edited, jaccard(shingles(t), shingles(edited)), len(shingles(t) | shingles(edited))),
                             (r.near_next, jaccard(shingles(t), shingles(after)), len(shingles(t) | shingles(after)))):
            assert 0 <= got <= 1
            wrong.append(abs(got - want))
            if n <= sketch.K:
                assert got == pytest.approx(want)
        if len(shingles(t)) < sketch.K:
            assert r.n_shingles == len(shingles(t))
        assert r.fingerprint == rows[texts.index(texts[i])].fingerprint
    assert max(wrong) < 0.2


def test_sketch_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sketch.compare_with_edit(df).count() == 4
    assert sketch.compare_with_edit(df.limit(0)).count() == 0
    one = sketch.compare_with_edit(df.limit(1)).collect()[0]
    assert one.near_next == 1.0


def test_sketches_merge(spark, texts):
    from pyspark.sql import functions as F

    a, b = texts[6], texts[8]
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketch.sketches(sketch.sketches(df, "a", "sa"), "b", "sb")
    low = df.select(sketch.merge(F.col("sa"), F.col("sb")).alias("m")).first().m
    both = sorted(set(df.first().sa) | set(df.first().sb))[:sketch.K]
    assert low == both


# --- vectors -----------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[100:180] = x[100] + 0.02 * rng.standard_normal((80, 16))  # a dense group
    x[200:230:2] = x[201:231:2] + 0.05 * rng.standard_normal((15, 16))
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(300 + i, x[5].tolist(), "s") for i in range(30)]  # equal ones
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, [None] + [1.0] * 15]
    rows += [(400 + i, v, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, tables=6).collect()}
    assert len(got) == len(rows)
    good = np.array([r[1] for r in rows[:330]])
    good /= np.linalg.norm(good, axis=1, keepdims=True)
    near = good @ good.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[r[0]].n_links for r in rows[:330])
    assert near.sum() * 0.9 <= found <= near.sum()
    for i in range(30):
        assert got[300 + i].component_id == 5 and not got[300 + i].kept
    assert {got[i].component_id for i in range(100, 180)} == {100}
    for i in range(len(bad)):
        r = got[400 + i]
        assert (r.n_links, r.component_id, r.kept) == (0, 400 + i, True)


def test_isolated_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((3000, 64)))
    pairs = unit(x[2000:] + 0.29 / 8 * rng.standard_normal((1000, 64)))  # cosines around 0.96
    hot = unit(x[:1] + 0.1 / 8 * rng.standard_normal((1500, 64)))
    every = np.concatenate([x, pairs, hot])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "id long, unit array<double>").cache()
    links = spark.createDataFrame([(0, 1)], "a long, b long").limit(0)
    group = df.where("id = 0 or id >= 4000").select("id")
    share, seen = neighbours.audit(df, links, group, 64, 0.95, 256)
    assert share < 0.1 and seen >= 300  # no pair is known
    every_pair = [(2000 + i, 3000 + i) for i in range(1000)]
    links = spark.createDataFrame(every_pair + [(b, a) for a, b in every_pair], "a long, b long")
    assert neighbours.audit(df, links, group, 64, 0.95, 256)[0] == 1.0


def test_signs_and_orders_grow():
    assert neighbours.leading_bits(300) == 6 and neighbours.leading_bits(1_000_000) == 16
    sizes = [neighbours.orders_needed(neighbours.leading_bits(10**k), 0.95, 0.98) for k in (2, 4, 6, 8)]
    assert sizes == sorted(sizes) and 1 < sizes[0] < sizes[-1]


def test_recall_not_reached_is_an_error(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="of the links"):
        neighbours.near_duplicates(df, tables=200, recall=1.01)


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_duplicates(df).count() == 0


def test_vector_query_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    got = queries.QUERIES["op3_nn_descent"](spark, folder).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.9 * (near.sum() - len(rows))


# --- shingle similarity ------------------------------------------------------------


def edited(rng, words, rate):
    return [f"w{rng.random()}" if rng.random() < rate else w for w in words]


def linked(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(k) for k in range(len(texts))}


def test_stage_links_by_shingle_similarity(spark, texts):
    import corpus_pipeline

    rng = random.Random(5)
    made = list(texts)
    for i in range(80):
        base = [f"{rng.randrange(10**6)}" for _ in range(rng.randint(100, 400))]
        made += [" ".join(base), " ".join(edited(rng, base, rng.uniform(0, 0.03)))]
    base = [f"{rng.randrange(10**6)}" for _ in range(300)]
    made += [" ".join(edited(rng, base, 0.012)) for _ in range(90)]  # a large group, pairs around 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(made)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()}
    assert kept == linked(made)


def test_stage_null_keys_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, None), (3, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in resemblance.one_of_each(df).collect()) == [(3, " "), (7, "a b c d")]
    assert resemblance.one_of_each(df.limit(0)).count() == 0
