"""Tokens and packing against the tokenizers library and against their definitions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelframe.llm import bpe, packing, queries

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, sequence_id string, lang string"
TEXTS = [
    None, "", " ", "\n\n", "Hello  World's end", "a" * 700, "x<|endoftext|>y <|startoftext|>", "Ωμέγα ΣΊΣΥΦΟΣ ſ İ", "日本語 と emoji 🎉🎉",
    "tab\there\r\nand there end", "½ ² ³ 12345 ١٢٣", "don't WE'LL they've", "é café", "\x1c\x85 odd", "  lead and trail  ",
    "— “quoted” …", "word " * 3000, "<|endoftext|>", "no_under_score __x__", "ends with space ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", None) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "null key", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def raw(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_encode_is_the_librarys(docs):
    tool = Tokenizer.from_file(WORDS)
    coded = bpe.encode(docs.select("doc_id", "text"), WORDS)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in coded.collect()]
    assert len(got) == len(TEXTS) + 2
    text = dict(enumerate(TEXTS)) | {None: "null key"}
    for key, ids, n in got:
        want = tool.encode(text[key] or "", add_special_tokens=False).ids
        assert ids == want, repr(text[key])
        assert n == len(want)
    for r in bpe.decode(coded, WORDS).collect():
        want = tool.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.decoded == tool.decode(want, skip_special_tokens=False)


def test_encode_query(spark, folder, raw):
    import hashlib

    tool = Tokenizer.from_file(WORDS)
    rows = queries.QUERIES["op1_bpe_round_trip"](spark, folder).collect()
    assert len(rows) == len(raw)
    for r in rows:
        ids = tool.encode(raw[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_tables(docs):
    none = docs.limit(0)
    assert bpe.encode(none.select("doc_id", "text"), WORDS).count() == 0
    assert packing.pack(none, BYTES).count() == 0


def test_kept_names_may_not_clash(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs, WORDS, keep=("ids",))


def checked(rows, texts, capacity):
    tool = Tokenizer.from_file(BYTES)
    ids = {k: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    cover, windows = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(cover) == set(ids)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return cover, windows, ids


def test_pack(docs):
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTES).collect()
    cover, _, ids = checked(rows, dict(enumerate(TEXTS)), 1024)
    for key, spans in cover.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[key])


def test_pack_repeated_rows_and_null_keys(docs):
    rows = packing.pack(docs, BYTES).collect()
    assert sum(r.start == 0 for r in rows) == len(TEXTS) + 2
    assert any(r.doc_id is None for r in rows)


def test_pack_query(spark, folder, raw):
    rows = queries.QUERIES["op4_pack_documents"](spark, folder).collect()
    _, windows, ids = checked(rows, raw, 1024)
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    used = [sum(n for _, n in w) for w in windows.values()]
    padding = sum(1024 - n for n in used if n & (n - 1))
    assert padding < 0.05 * total


def test_plan_covers_every_remainder():
    rng = random.Random(3)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 64), 40)}
    counts[60] = 5000
    rows, windows = packing.assignment(counts, 64)
    load = {}
    ranks = {n: set() for n in counts}
    for length, first, last, window, uses, offset in rows:
        for r in range(first, last + 1):
            ranks[length].add(r)
            w = window + (r - first) // uses
            load.setdefault(w, []).append((offset + length * ((r - first) % uses), length))
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    assert set(load) == set(range(windows))
    for spans in load.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_best_filling_is_optimal():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 40)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        used = packing.best_filling(counts, room)
        assert sum(n * c for n, c in used.items()) == max(sums)
        assert all(c <= counts[n] for n, c in used.items())
