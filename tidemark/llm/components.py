"""Connected components by alternating star contraction, as joins and aggregates only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stored


class Forest:
    """Union-find over the points of one task: only a spanning forest leaves the task, never all pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link i[k] with j[k]: label minima in numpy for many pairs, then unions of what is left."""
        while len(i):
            i, j = self.root[i], self.root[j]
            while True:
                i2, j2 = self.root[i], self.root[j]
                if (i2 == i).all() and (j2 == j).all():
                    break
                i, j = i2, j2
            open_ = i != j
            lo, hi = np.minimum(i, j)[open_], np.maximum(i, j)[open_]
            np.minimum.at(self.root, hi, lo)
            i, j = lo, hi

    def roots(self) -> np.ndarray:
        """The smallest point that each point is linked to."""
        root = self.root
        while (root[root] != root).any():
            root = root[root]
        return root


def _is_star(edges: DataFrame) -> bool:
    """True if every child has one root and no root is a child."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("child")).unionAll(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("child"))
    )
    bad = ends.groupBy("n").agg(F.sum("child").alias("c"), F.min("child").alias("r"))
    return bad.where("c > 1 or (c > 0 and r = 0)").isEmpty()


def _written(least: DataFrame) -> DataFrame:
    """A join with an aggregate on its key keeps a hub's links in one task; with a written table they can be split."""
    return stored(least, "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it sees."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = _written(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of the undirected graph ``edges(a long, b long)`` with the smallest node they reach.

    Returns ``(node, root)`` for every node that has a link to another node. Null ends and loops are ignored;
    repeated links count once; an empty table gives an empty result. Every round is two aggregates and two joins
    whose groups pre-aggregate, so a hub node costs one row a task; its table is written, so lineage stays short.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        if _is_star(edges):
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        edges = stored(_small_star(_large_star(edges)), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
