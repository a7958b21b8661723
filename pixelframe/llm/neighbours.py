"""Near-duplicate vectors by NN-descent on a neighbour graph.

Equal vectors are collapsed first and counted. A start graph links each vector with those
next to it in several random orders (signs of random projections, then one projection).
NN-descent then refines it: the lists of a vector and of those that list it are brought
together, every two of its neighbours are compared, and what improves a list is merged
into it, until hardly anything changes. An audit compares some vectors with all rows; as
long as too few of the true links of a vector were found, new random orders join the
graph. The signs that lead an order grow with the logarithm of the number of vectors.

A list that is full of links (cosine at or above the threshold) is saturated: its vector
may have more links than the list holds. Its list is enlarged to the whole group it is
in: all members of that group are compared in blocks, and only counts leave a task. So
groups of any size are counted exactly, with no list or task that holds a whole group.

Defined cases: a vector that is null, zero, of another length than most, or holds a null
or non-finite component links with nothing; equal vectors link with each other; rows
with equal ids are vectors of their own (they count as links) in one component; null ids
are left out of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import written
from .graph import components

LIST = 12  # neighbours of a vector
TABLES = 10  # random orders of the start graph
ORDERS = 200  # or three times those a pair at the threshold needs: then too low a recall is an error
BITS = 6  # signs that lead an order, at least
REACH = 6  # places before and after in an order
ROUNDS = 4
AUDIT = 256  # vectors compared with all rows, at first
AUDIT_MOST = 16_384
LINKS = 300  # true links outside groups that an audit should see
RECALL = 0.98
BLOCK = 256  # vectors of a block when a group is compared as a whole


def planes(table: int, dims: int, bits: int) -> np.ndarray:
    return np.random.default_rng(7919 * table + dims).standard_normal((dims, bits + 1))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def ordered(vectors: DataFrame, tables: range, dims: int, bits: int) -> DataFrame:
    """(place, spot, id, unit) of every vector in each random order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                x = matrix(some.column(1), dims)
                for t in tables:
                    p = x @ planes(t, dims, bits)
                    signs = (p[:, :bits] > 0) @ (1 << np.arange(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signs.astype(np.int64) + (t << 32)), pa.array(p[:, bits]), some.column(0), some.column(1)],
                        ["place", "spot", "id", "unit"])

    return vectors.select("id", "unit").mapInArrow(run, "place long, spot double, id long, unit array<double>")


def adjacent(rows: DataFrame, dims: int, reach: int) -> DataFrame:
    """(a, b, sim) of the vectors up to `reach` places apart in an order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for part in parts:
            place, ids = part.column(0).to_numpy(), part.column(2).to_numpy()
            x = matrix(part.column(3), dims)
            if tail is not None:
                place, ids, x = (np.concatenate(z) for z in zip(tail, (place, ids, x)))
            fresh = len(place) - part.num_rows
            for d in range(1, min(reach, len(ids) - 1) + 1):
                ok = place[d:] == place[:-d]
                ok[:max(0, fresh - d)] = False  # pairs inside the carried tail were given before
                i = np.flatnonzero(ok)
                for at in range(0, len(i), 20_000):
                    k = i[at:at + 20_000]
                    sim = np.einsum("ij,ij->i", x[k], x[k + d])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[k + d]), pa.array(sim)], ["a", "b", "sim"])
            tail = (place[-reach:], ids[-reach:], x[-reach:])

    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartitionByRange(int(parts), "place", "spot").sortWithinPartitions("place", "spot", "id")
    return dealt.mapInArrow(run, "a long, b long, sim double")


def lists(pairs: DataFrame, size: int) -> DataFrame:
    """(id, near): the best `size` different neighbours of each vector, both ways."""

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, near = part.column(0), []
            for found in part.column(1).to_pylist():
                top = dict(sorted(((f["b"], f["sim"]) for f in found), key=lambda p: (-p[1], p[0]))[:4 * size])
                near.append([{"b": b, "sim": s} for b, s in list(top.items())[:size]])
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, part.schema.field(1).type)], ["id", "near"])

    # a vector meets a bounded number of others in a round: orders x reach, or its lists' squares
    both = pairs.union(pairs.select("b", "a", "sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    held = both.groupBy("a").agg(F.collect_list(F.struct("b", "sim")).alias("near")).withColumnRenamed("a", "id")
    return held.mapInArrow(best, held.schema)


def flat(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("a"), F.explode("near").alias("n")).select("a", "n.b", "n.sim")


def joined_neighbours(graph: DataFrame, vectors: DataFrame, dims: int, size: int) -> DataFrame:
    """(a, b, sim) of pairs of neighbours of a vector that improve the list of one."""
    worst = graph.select("id", F.when(F.size("near") < size, F.lit(-2.0)).otherwise(F.element_at("near", -1)["sim"]).alias("worst"))
    out = flat(graph).select(F.col("a").alias("centre"), F.col("b").alias("id"), "sim")
    back = flat(graph).select(F.col("b").alias("centre"), F.col("a").alias("id"), "sim")
    # of those that list a vector the closest come: as many as its own list holds
    back = lists_of_centre(back, size)
    members = out.select("centre", "id").union(back).distinct().join(vectors.join(worst, "id").select("id", "unit", "worst"), "id")
    rooms = members.groupBy("centre").agg(F.collect_list(F.struct("id", "worst", "unit")).alias("room"))  # 2 x size at most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b, s = [], [], []
            rooms = part.column(1)
            ends = rooms.offsets.to_numpy()
            inner = rooms.flatten()
            base = ends[0]
            ids, worst = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            x = matrix(inner.field(2), dims)
            for lo, hi in zip(ends[:-1] - base, ends[1:] - base):
                sim = x[lo:hi] @ x[lo:hi].T
                i, j = np.nonzero(np.triu((sim > worst[lo:hi, None]) | (sim > worst[None, lo:hi]), 1))
                a.append(ids[lo:hi][i])
                b.append(ids[lo:hi][j])
                s.append(sim[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b, s)], ["a", "b", "sim"])

    return rooms.mapInArrow(run, "a long, b long, sim double")


def lists_of_centre(back: DataFrame, size: int) -> DataFrame:
    """(centre, id): the closest `size` of those that list a centre, combined map-side."""
    # a popular centre may be listed by very many: first the best within slots, then of those
    slot = F.pmod(F.xxhash64("id"), F.lit(256))

    def best(df: DataFrame, *keys: str) -> DataFrame:
        top = F.slice(F.sort_array(F.collect_list(F.struct("sim", "id")), asc=False), 1, size)
        return df.groupBy(*keys).agg(top.alias("top")).select("centre", F.explode("top").alias("t")).select("centre", "t.sim", "t.id")

    return best(best(back.withColumn("slot", slot), "centre", "slot"), "centre").select("centre", "id")


def audit(vectors: DataFrame, links: DataFrame, apart: DataFrame, dims: int, threshold: float, sample: int) -> tuple[float, int]:
    """Recall of the true links of vectors apart from groups, and how many links it rests on.

    Recall is the mean over vectors of the share of their links that is known, so a vector
    of one link counts like one of a million. `apart` (id) are the vectors in or next to a
    group that will be counted as a whole; those groups are audited once they are known.
    The sample grows until LINKS links are seen, AUDIT_MOST vectors at most.
    """
    pool = vectors.join(apart, "id", "left_anti")
    none = links.select(F.col("a").alias("id"), F.col("a").alias("group")).limit(0)
    while True:
        share, seen, size = audited(vectors, pool, links, none, dims, threshold, sample)
        if seen >= LINKS or size < sample or sample >= AUDIT_MOST:
            # a sample of the whole pool is no estimate
            return share, LINKS if size < sample else seen
        sample = min(AUDIT_MOST, sample * 8)


def audited(vectors: DataFrame, pool: DataFrame, links: DataFrame, dense: DataFrame, dims: int, threshold: float,
            sample: int) -> tuple[float, int, int]:
    """(mean known share, true links, audited vectors) of some vectors of a pool."""
    some = pool.orderBy(F.xxhash64("id")).limit(sample).select("id", "unit").toArrow().combine_chunks()
    if not some.num_rows:
        return 1.0, 0, 0
    ids = some.column(0).to_numpy()
    x = some.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dims)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                rows = part.slice(at, 512)
                own = rows.column(0).to_numpy()
                i, j = np.nonzero(matrix(rows.column(1), dims) @ x.T >= threshold)
                keep = own[i] != ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(ids[j][keep]), pa.array(own[i][keep])], ["a", "b"])

    true = vectors.select("id", "unit").mapInArrow(run, "a long, b long")
    # known are the pairs in links and those inside a group that is counted as a whole
    known = links.select("a", "b", F.lit(1).alias("hit"))
    whole = dense.select(F.col("id").alias("a"), F.col("group").alias("ga"))
    other = dense.select(F.col("id").alias("b"), F.col("group").alias("gb"))
    judged = true.join(known, ["a", "b"], "left").join(whole, "a", "left").join(other, "b", "left")
    found = F.coalesce("hit", (F.col("ga") == F.col("gb")).cast("int"), F.lit(0))
    each = judged.groupBy("a").agg(F.avg(found).alias("share"), F.count(F.lit(1)).alias("n"))
    share, seen = each.agg(F.avg("share"), F.sum("n")).first()
    return (1.0 if share is None else share), seen or 0, some.num_rows


def leading_bits(n: int) -> int:
    """Signs that leave about 16 vectors in a cell of an order."""
    return min(30, max(BITS, int(np.ceil(np.log2(max(1, n) / 16)))))


def orders_needed(bits: int, threshold: float, recall: float) -> int:
    """Orders in one of which a pair at the threshold shares all signs, with probability recall."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return 1 if same >= recall else int(np.ceil(np.log(max(1e-9, 1 - recall)) / np.log1p(-same)))


def group_counts(members: DataFrame, dims: int, threshold: float, block: int) -> DataFrame:
    """(id, n): for members (group, id, unit, copies, size) of saturated groups, how many
    vectors of the group link with each, itself left out; every two blocks meet once."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    rows = members.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "copies", "unit")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pairs = part.column(1)
            for at in range(part.num_rows):
                room = pairs.slice(at, 1).flatten()
                lo, hi = part.column(0)[at]["lo"].as_py(), part.column(0)[at]["hi"].as_py()
                side, ids, copies = (room.field(k).to_numpy() for k in range(3))
                x = matrix(room.field(3), dims)
                a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
                near = x[a] @ x[b].T >= threshold
                if lo == hi:
                    near &= ~np.eye(len(a), dtype=bool)
                    got = [(ids[a], near @ copies[b])]
                else:
                    got = [(ids[a], near @ copies[b]), (ids[b], near.T @ copies[a])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got])) for k in (0, 1)], ["id", "n"])

    rooms = rows.groupBy(F.struct("group", "lo", "hi").alias("key")).agg(F.collect_list(F.struct("own", "id", "copies", "unit")).alias("room"))
    counted = rooms.mapInArrow(run, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", size: int = LIST,
                    tables: int = TABLES, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """key, n_links, component_id and kept for every row."""
    dims = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = dims[0] if dims else 0
    usable = F.exists("x", lambda v: v != 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).withColumn("ok", F.coalesce(usable & (F.size("x") == dims), F.lit(False)))
    # scaled by the largest component first, so that no square overflows or vanishes
    rows = rows.withColumn("top", F.array_max(F.transform("x", lambda v: F.abs(v))))
    rows = rows.withColumn("x", F.when(F.col("ok"), F.transform("x", lambda v: v / F.col("top"))))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    rows = rows.withColumn("norm", norm).withColumn("unit", F.transform("x", lambda v: v / F.col("norm")))
    rows = written(rows.select("key", F.when(F.col("ok"), F.xxhash64("unit")).alias("id"), "unit"))
    vectors = written(rows.where("id is not null").groupBy("id").agg(
        F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("least")))

    bits = leading_bits(vectors.count())
    enough = orders_needed(bits, threshold, recall)
    graph, seen, done = None, None, 0
    while True:
        fresh = written(adjacent(ordered(vectors, range(done, done + tables), dims, bits), dims, REACH))
        done += tables
        graph = written(lists(fresh if graph is None else fresh.union(flat(graph)), size))
        state = None
        for _ in range(rounds):
            better = joined_neighbours(graph, vectors, dims, size)
            graph = written(lists(flat(graph).union(better), size))
            total = graph.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda a, n: a + n["sim"]))).first()[0] or 0.0
            if state is not None and total - state <= 1e-3 * abs(total):
                break
            state = total
        one_way = flat(graph).union(fresh).where(F.col("sim") >= threshold).select("a", "b")
        one_way = one_way if seen is None else one_way.union(seen)
        links = seen = written(one_way.union(one_way.select("b", "a")).distinct())
        full = graph.where((F.size("near") >= size) & (F.element_at("near", -1)["sim"] >= threshold)).select("id")
        apart = written(full.union(links.join(full, links["b"] == full["id"], "left_semi").select("a")).distinct())
        share, judged = audit(vectors, links, apart, dims, threshold, AUDIT)
        # where hardly any link is seen, the orders must be as many as a pair at the threshold needs
        if share >= recall and (judged >= LINKS or done >= enough):
            group = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
            inside = vectors.join(group, vectors["id"] == group["node"]).select("component", "id", "unit", "copies")
            dense = group.join(full, group["node"] == full["id"]).select("component").distinct()
            sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
            members = written(inside.join(dense.join(sizes, "component"), "component").select(
                F.col("component").alias("group"), "id", "unit", "copies", "size"))
            share, _, _ = audited(vectors, vectors.join(members.select("id"), "id", "left_semi"), links, members, dims, threshold, AUDIT)
            if share >= recall:
                break
        if done >= max(ORDERS, 3 * enough):
            raise RuntimeError(f"{share:.4f} of the links of audited vectors are known after {done} orders, not {recall}")
    exact = group_counts(members, dims, threshold, BLOCK)
    other = vectors.select(F.col("id").alias("b"), "copies")
    sparse = links.join(members.select(F.col("id").alias("a")), "a", "left_anti").join(other, "b").groupBy("a").agg(F.sum("copies").alias("n"))
    counted = exact.union(sparse.select("a", "n"))
    named = vectors.join(group, vectors["id"] == group["node"], "left").withColumn("group", F.coalesce("component", "id"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    of = named.join(least, "group").join(counted.withColumnRenamed("id", "counted"), F.col("id") == F.col("counted"), "left").select(
        "id", "copies", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    joined = rows.join(of, "id", "left")
    return joined.select(
        F.col("key").alias(key), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.when(F.col("id").isNull(), F.col("key"))).cast("long").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
