"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.batches import by_value
from casewatch.plans.lineage import cut_lineage, delete_written

by_value(__name__)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: ordered, not null), root being the smallest node it reaches.

    Nodes without an edge to another node are not listed. Star contraction needs about log2(longest path)
    rounds; each is two joins on node ids and is written to the shared folder. A node with very many
    neighbours is only a partial aggregate and one side of an inner join that adaptive execution can split.
    """
    stars = cut_lineage(edges.where("a <> b").distinct(), "edges")
    seen = None
    while True:
        found = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(found) == seen or not found[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = tuple(found), stars
        stars = cut_lineage(_small_star(_large_star(stars)), "edges")
        delete_written(before)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of `a[i]` and `b[i]`; `parent` names the smallest member of every set before and after."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up
