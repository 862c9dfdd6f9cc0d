"""Connected components of a link table by local union-find, hooking and pointer jumping, all of it on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


class UnionFind:
    """Disjoint sets over integers; the root of a set is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, x)
        return top

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as a star forest: every node with the smallest of its component, one row a node."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.union(a, b)
        nodes = np.fromiter(sets.parent, np.int64, len(sets.parent))
        roots = np.fromiter(map(sets.find, sets.parent.copy()), np.int64, len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b) that isn't itself the smallest of its component.

    Each pass hooks every node below its smallest neighbour, follows the pointers to their ends and replaces links by
    links between roots; the number of passes grows with the logarithm of the component size. Smallest neighbours are
    combined before the shuffle, and joins are between written tables, so a hot root's rows can be split among tasks.
    Self links and null ends are ignored; repeated links don't matter; no links give no rows.
    """
    live = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "a long, b long")
    live = staged(live.where("a <> b").distinct(), "links")
    forest: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = staged(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a"), "parent")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = staged(parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parent")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        below = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        if forest is None:
            forest = below
        else:  # roots so far that now hang below another
            moved = below.select(F.col("node").alias("root"), F.col("root").alias("new"))
            forest = staged(forest.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(below), "forest")
        left, right = parent.select("a", F.col("p").alias("ra")), parent.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        live = live.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        live = staged(live.where("a <> b").distinct(), "links")
    return forest if forest is not None else links.sparkSession.createDataFrame([], "node long, root long")
