"""Connected components of a graph that lives in a table: union-find within tasks, then stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import scratch


class UnionFind:
    """Disjoint sets whose root is their smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = self.parent[min(a, b)] = min(a, b)


#: Nodes that a task joins before it hands on what it has found, so that its memory stays bounded.
LOCAL_NODES = 1_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()

    def stars() -> pa.RecordBatch:
        nodes = [n for n in sets.parent if sets.find(n) != n]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(n) for n in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(u, v)
        if len(sets.parent) > LOCAL_NODES:
            yield stars()
            sets.parent.clear()
    yield stars()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one link up, to a node that has none."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links`, a frame of two long columns; the component is its smallest node.

    Each task first joins its own links with union-find, which leaves at most a
    star for each component it met.  Then large and small stars alternate: every
    node links its larger, then its smaller neighbours to the smallest of them,
    until only stars are left.  Minima are pre-aggregated, and joins back to them
    can be split where one node has very many links.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = scratch.table(edges.mapInArrow(_local, "u long, v long").distinct(), "edges")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
