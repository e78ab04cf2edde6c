"""Connected components of a large edge table: union-find within tasks, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Edges a task holds in its union-find at once.
AT_ONCE = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) replaced by (member, least member) of the groups they form in this task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def emit() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > AT_ONCE:
            yield emit()
    yield emit()


def _shrink(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "u long, v long")


def components(s: Scratch, edges: DataFrame) -> DataFrame:
    """(u, v), a table of s: the least node v that can be reached from u, for each u that isn't its component's least node.

    edges: (u, v), in any direction. Each round joins every node's larger neighbours to its least one, then its smaller
    ones, which at least halves the depth; a hub's edges are aggregated before they are shuffled and joined, not grouped.
    The tables of a round are deleted when the next one is written.
    """
    now = s.write(_shrink(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")), "cc")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before and state[0] == state[2]:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = s.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = s.write(large.where("u <> v").distinct(), "cc-large")
        # Now u > v throughout: join each u's smaller neighbours, and u, to the least of them.
        nearest = s.write(large.groupBy("u").agg(F.min("v").alias("m")), "cc-nearest")
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(nearest.select("u", F.col("m").alias("v")))
        last, now = now, s.write(small.distinct(), "cc")
        s.drop(last, least, large, nearest)
