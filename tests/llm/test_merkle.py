"""The Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pixelframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, copies int, _tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """(doc_id, leaf) -> list of (subroot, root, proof, folded_root) by building every level."""
    def leaf(r, text):
        return h(*map(field, (r[0], r[3], r[2], r[4], text)))

    def changed(r):
        even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
        return r[1].replace("\n", "") if even and r[1] is not None else r[1]

    def build(leaves):
        """Root, and for every leaf its (others, position) a level."""
        paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for i, a in enumerate(at):
                run = level[a - a % 3: a - a % 3 + 3]
                paths[i].append((run[:a % 3] + run[a % 3 + 1:], a % 3))
            level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
            at = [a // 3 for a in at]
        return level[0], paths

    def fold(digest, path):
        for others, pos in path:
            digest = h(*others[:pos], digest, *others[pos:])
        return digest

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = [(r, leaf(r, r[1]), leaf(r, changed(r))) for r in rows if r[3] == s]
        own.sort(key=lambda o: (o[0][0] is not None, o[0][0] or 0, o[1]))
        trees.append((own, *build([o[1] for o in own])))
    root, tops = build([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for (r, digest, given), path in zip(own, paths):
            proof = "".join(d for others, _ in path + top for d in others)
            out.append((r[0], digest, subroot, root, h(proof), fold(fold(given, path), top)))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_against_plain(spark, height):
    rows = [(i, f"line {i}\nnext" if i % 3 else "no break", "en", f"s{'abcé'[i % 4]}", i, "x", 3, "t") for i in range(90)]
    rows += [(500 + i, "a\nb", "fr", "hot", 3, "x", 3, "t") for i in range(41)]
    rows += [(i, "", None, None, None, "y", 4, "t") for i in (7, 900)] + [(901, None, "de", "lone", 0, "y", 4, "t")]
    rows += [(None, "null key\n", "en", "sa", 1, "y", 4, "t"), (3, "same key", "en", "sd", 1, "y", 4, "t")]
    rows += [(44, "copy\n", "en", "copies", 5, "y", 4, "t")] * 31 + [(45, "l\n" * 50_000, "en", "sa", 5, "y", 4, "t")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(df, merkle.without_line_ends(), height=height)
    want = plain(rows)
    assert sorted((tuple(r[:6]) for r in got.collect()), key=str) == want
    assert got.where(~F.col("verified")).count() == sum(w[3] != w[5] for w in want) > 0


def test_untouched_rows_verify_and_one_row_is_the_root(spark):
    df = spark.createDataFrame([(1, "a", "en", None, 1, "", 0, "")], SCHEMA)
    row = merkle.manifest(df).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_frontier(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = merkle.Frontier()
    for d in digests:
        tree.append(d)
    root = tree.close(merkle.levels_of(n))
    assert all(merkle.fold(d, i, n, bytes(w)) == root for i, (d, w) in enumerate(zip(digests, tree.witness)))
