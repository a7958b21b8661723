"""Merkle manifest of a table with a witness for every row, built by appending.

The rows of one source are the leaves of its tree, in key order. A leaf is
H(each field: "-" if null, else byte count, ":", value); H is the lowercase
hexadecimal SHA-256 of its inputs in a row. Every three nodes in a row (the last run
may be shorter, even one) become their H until one node is left, the source's subroot.
Subroots, ordered by source, make the root in the same way.

Incremental witnesses: a frontier keeps the open run of every level. A node that is
appended puts itself at the end of the witness of all leaves below the nodes that wait
in its run, and these into the witnesses of its own leaves; a full run is hashed and
appended one level up. Leaves are streamed in aligned blocks of 3^7 = 2187, so that blocks
are independent tasks. A block's root is a further append, as a leaf of the next
table, 2187 times smaller; its witness is then joined behind that of the block's own
leaves. No task holds more than one block, and the driver sees one number a round.

Defined cases: a null field is "-"; a null key comes first and counts as the empty
text where its checksum decides; a null source is a source of its own, before all
others; the empty text is "0:"; rows with one key are ordered by their leaf, and equal
rows are leaves of their own, counted before they are shuffled; an empty table gives
an empty manifest; columns that are no field play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

RUN = 3
HEIGHT = 7  # levels inside a block
TREE = ["_some", "_tree"]  # the source: whether there is one, and its name
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(digests: list[bytes]) -> bytes:
    """H of digests, which count as their hexadecimal text."""
    return sha256(b"".join([d.hex().encode() for d in digests])).digest()


def levels_of(n: int) -> int:
    """How often n nodes are combined until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // RUN), height + 1
    return height


class Frontier:
    """Open subtrees of a tree that grows at its right end, and the witnesses so far."""

    def __init__(self):
        self.witness: list[bytearray] = []
        self.open: list[list[tuple[bytes, int, int]]] = []

    def append(self, digest: bytes) -> None:
        """The next leaf."""
        at = len(self.witness)
        self.witness.append(bytearray())
        self.place(0, (digest, at, at + 1))

    def place(self, level: int, node: tuple[bytes, int, int]) -> None:
        """A finished subtree joins the open run of its level."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        digest, low, high = node
        for other, first, last in run:
            for w in self.witness[first:last]:
                w += digest
            for w in self.witness[low:high]:
                w += other
        run.append(node)
        if len(run) == RUN:
            self.finish(level)

    def finish(self, level: int) -> None:
        """The open run of a level becomes a node of the next."""
        run, self.open[level] = self.open[level], []
        self.place(level + 1, (joined([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def close(self, height: int) -> bytes:
        """The digest after `height` levels; short last runs are hashed as they are."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self.finish(level)
        return self.open[height][0][0]


def fold(digest: bytes, rank: int, n: int, witness: bytes) -> bytes:
    """The top of a tree of n leaves from the leaf of that rank and its witness."""
    at = 0
    while n > 1:
        pos = rank % RUN
        others = min(RUN, n - rank + pos) - 1
        run = [witness[at + 32 * i: at + 32 * i + 32] for i in range(others)]
        run.insert(pos, digest)
        digest, at, rank, n = joined(run), at + 32 * others, rank // RUN, -(-n // RUN)
    return digest


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, in their order."""
    texts = [c.cast("string") for c in fields.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds rank (of the first copy in its tree) and n, the leaves of the tree.

    Nodes are dealt into ranges of (tree, order), a range's part of a tree is counted,
    and counts are added up: one row per part, whatever the size of a tree.
    """
    dealt = written(nodes.repartitionByRange(*TREE, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*TREE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*TREE, "_part").agg(F.sum("copies").alias("_rows"))
    sizes = sizes.select(
        *TREE, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*TREE)).alias("n"),
    )
    inside = Window.partitionBy(*TREE, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("_place")
    placed = dealt.select("*", place).join(sizes, [*TREE, "_part"])
    return placed.withColumn("rank", F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")


def appended(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per leaf with its witness inside its block; `top`, the block's root, on the first.

    nodes: tree, n, rank, copies, digest and any payload columns.
    """
    size = RUN ** height
    ends = F.col("rank") + F.col("copies")
    of = nodes.withColumn("_block", F.explode(F.expr(f"sequence(rank div {size}, (rank + copies - 1) div {size})")))
    start = F.greatest("rank", F.col("_block") * size)
    of = of.withColumns({"_from": start, "copies": F.least(ends, (F.col("_block") + 1) * size) - start})
    of = of.withColumn("rank", F.col("_from")).drop("_from")
    keep = [c for c in of.columns if c not in ("copies", "_block")]
    of = of.select(*TREE, "_block", "copies", *[c for c in keep if c not in TREE])
    dealt = of.repartition(*TREE, "_block").sortWithinPartitions(*TREE, "_block", "rank")
    kept = [*of.columns[:2], *of.columns[4:]]
    at_n, at_rank, at_digest = kept.index("n"), kept.index("rank"), kept.index("digest")

    def block(rows: list[tuple]) -> list[tuple]:
        tree = Frontier()
        for row in rows:
            tree.append(row[at_digest])
        n = rows[0][at_n]
        top = tree.close(min(height, levels_of(n)))
        return [(*r, bytes(w), None if i else top) for i, (r, w) in enumerate(zip(rows, tree.witness))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*kept, "witness", "top"])

        for part in parts:
            types = [*[part.schema.field(c).type for c in kept], pa.binary(), pa.binary()]
            for some, name, at, copies, *rest in zip(*[c.to_pylist() for c in part.columns]):
                if own != (some, name, at):
                    if rows:
                        out += block(rows)
                    own, rows = (some, name, at), []
                    if len(out) >= 4096:
                        yield batch()
                for i in range(copies):
                    moved = [some, name, *rest]
                    moved[at_rank] += i
                    rows.append(tuple(moved))
        if rows:
            out += block(rows)
        if out:
            yield batch()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (of.schema[c] for c in kept))
    return dealt.mapInArrow(run, f"{fields}, witness binary, top binary")


def grown(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of leaves, of their blocks' roots, and so on, up to one node a tree."""
    levels, size = [written(appended(nodes, height))], RUN ** height
    while True:
        roots = levels[-1].where("top IS NOT NULL").select(
            *TREE, F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.expr(f"rank div {size}").alias("rank"),
            F.lit(1).cast("long").alias("copies"), F.col("top").alias("digest"))
        if (roots.agg(F.max("n")).first()[0] or 1) == 1:
            return [*levels, roots.drop("copies")]
        levels.append(written(appended(roots, height)))


def completed(levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The leaves with whole witnesses and the columns of `above`, which has a row a tree.

    Goes down from the subroots, so that every join meets rows by (tree, block).
    """
    more = [c for c in above.columns if c not in TREE]
    found = above.withColumns({"_at": F.lit(0).cast("long"), "_rest": F.lit(b"")})
    for level in reversed(levels[:-1]):
        own = [c for c in level.columns if level is levels[0] and c not in ("witness", "top", *TREE)]
        level = level.withColumn("_at", F.expr(f"rank div {RUN ** height}"))
        level = level.join(found, [*TREE, "_at"]).withColumn("_rest", F.concat("witness", "_rest"))
        found = level.select(*TREE, *own, *more, "_rest", F.col("rank").alias("_at"))
    return found.withColumnRenamed("_rest", "witness").drop("_at")


def manifest(df: DataFrame, tampered: dict[str, Column] | None = None, key: str = "doc_id", tree: str = "source",
             fields: tuple[str, ...] = FIELDS, height: int = HEIGHT) -> DataFrame:
    """One row per row of df: key, leaf, subroot, root, proof_sha256, folded_root, verified;
    then source, rank, n, source_rank, sources and the witnesses inside the source and above it.

    tampered: fields as they are found later, by name; folded_root is made from them and
    the original witness, and verified says whether it equals the root.
    """
    clean = {f: F.col(f) for f in fields}
    rows = df.select(
        F.col(tree).isNotNull().alias("_some"), F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("_tree"),
        F.col(key).alias("_key"), leaf(clean).alias("digest"), leaf(clean | (tampered or {})).alias("given"))
    nodes = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    leaves = grown(ranked(nodes, ["_key", "digest", "given"]), height)
    flat = leaves[-1].select(
        F.lit(True).alias("_some"), F.lit("").alias("_tree"), F.col("_some").alias("of_some"),
        F.col("_tree").alias("of_tree"), "digest", F.lit(1).cast("long").alias("copies"))
    tops = grown(ranked(flat, ["of_some", "of_tree"]), height)
    root = tops[-1].select(*TREE, F.col("digest").alias("root"))
    above = completed(tops, root, height).select(
        F.col("of_some").alias("_some"), F.col("of_tree").alias("_tree"), F.col("digest").alias("subroot"), "root",
        F.col("rank").alias("source_rank"), F.col("n").alias("sources"), F.col("witness").alias("source_witness"))
    whole = completed(leaves, above, height)
    extra = ["n", "rank", "source_rank", "sources", "witness", "source_witness"]
    names = ["proof_sha256", "folded_root"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in ("given", *extra)}
            proofs, tops = [], []
            for given, n, rank, at, sources, inner, outer in zip(*column.values()):
                proofs.append(sha256((inner + outer).hex().encode()).hexdigest())
                tops.append(fold(fold(given, rank, n, inner), at, sources, outer).hex())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(proofs, pa.string()), pa.array(tops, pa.string())],
                                             [*part.schema.names, *names])

    low = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root")}
    whole = whole.withColumns(low)
    fields_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    checked = whole.mapInArrow(run, f"{fields_ddl}, proof_sha256 string, folded_root string")
    return checked.select(
        F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        F.when(F.col("_some"), F.col("_tree")).alias("tree"), *extra)


def without_line_ends(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Tampering: rows whose key's checksum is even lose the line feeds of their text."""
    even = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return {text: F.when(even, F.translate(text, "\n", "")).otherwise(F.col(text))}


def sql(depth: int = 16) -> str:
    """The manifest's query in DuckDB SQL, for sources of up to 3^depth rows."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    row = " || ".join(field.format(f) for f in FIELDS)
    odd = row.replace(field.format("text"), field.format("found"))
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {bits}), 4294967295)"
    parts = [f"""
t AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM documents),
a0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY s) AS n,
         doc_id, sha256({row}) AS d, sha256({odd}) AS f FROM t),
pa0 AS (SELECT s, i, doc_id, d AS leaf, '' AS proof, f FROM a0)"""]
    def tree(name: str, ids: str) -> None:
        for k in range(depth):
            at = 3 ** k
            parts.append(f"""
{name}{k + 1} AS (SELECT s, i // 3 AS i, (any_value(n) + 2) // 3 AS n,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY s, i // 3),
{name}r{k} AS (SELECT s, i // 3 AS j, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY s, i // 3),
p{name}{k + 1} AS (SELECT p.s, p.i, {ids},
  proof || array_to_string(ds[:(p.i // {at}) % 3] || ds[(p.i // {at}) % 3 + 2:], '') AS proof,
  CASE WHEN n > 1 THEN sha256(array_to_string(ds[:(p.i // {at}) % 3], '') || f ||
    array_to_string(ds[(p.i // {at}) % 3 + 2:], '')) ELSE f END AS f
  FROM p{name}{k} p JOIN {name}r{k} r ON p.s = r.s AND p.i // {3 * at} = r.j)""")
    tree("a", "doc_id, leaf")
    parts.append(f"""
b0 AS (SELECT 0 AS s, s AS i, (SELECT count(*) FROM a{depth}) AS n, d FROM a{depth}),
pb0 AS (SELECT 0 AS s, p.s AS i, doc_id, leaf, a.d AS subroot, proof, f FROM pa{depth} p JOIN a{depth} a ON p.s = a.s)""")
    tree("b", "doc_id, leaf, subroot")
    return f"""WITH {",".join(parts)}
SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.d AS verified
FROM pb{depth}, b{depth} b"""
