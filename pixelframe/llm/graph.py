"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written


def forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (u, v) replaced by (root, node): union-find, fewer rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for part in parts:
            for u, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter(map(find, list(parent)), np.int64, len(parent))
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(roots[keep]), pa.array(nodes[keep])], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Large star and small star in turn: neighbours are hung on the smallest node of
    the neighbourhood until nothing moves. Both steps are a minimum by node and an
    equi join, so a node with very many edges is combined on the map side and its
    join side can be split. Lineage is cut after each round; only a row count and a
    checksum reach the driver. Nulls and loops are ignored; no edge, no row.
    """
    now = written(forest(edges.where("u <> v")).distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("u"), F.col("b").alias("v"))
        large = large.where("u <> v").distinct()
        # every edge now points from a larger node v to a smaller node u
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")
        )
        now = written(small.select("e.u", "e.v").where("u <> v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("v").agg(F.min("u").alias("u")).select(
        F.col("v").alias("node"), F.col("u").alias("component")
    ).union(now.select("u", F.col("u").alias("c")).distinct())
