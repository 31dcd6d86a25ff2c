"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered, ship


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges from each node to the smallest of its component, within one batch."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, r) for x in up if (r := find(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = spanning(list(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b: long), component being its smallest node.

    Each round joins edges with the smallest neighbour of their ends, so no node's neighbours are
    gathered in a row; Spark splits the join of a node with very many. Rounds are written to the
    shared folder, and end when nothing changes. Self-loops and nulls are left out.
    """
    ship(edges.sparkSession)
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = scratch.keep(gathered(clean.mapInArrow(_contract, "a long, b long").distinct()))
    state = None
    for _ in range(most_rounds):
        # large star: larger neighbours of a node join its smallest
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node, and itself, join the smallest
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(gathered(moved.union(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()))
        new = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
