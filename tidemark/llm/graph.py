"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

MOST_ROUNDS = 100


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root): of every node that has an edge (a, b), the smallest node reachable.

    Large-star and small-star steps in turn; each round's edges are written to folder, which cuts lineage. A node's
    neighbours are never gathered: their minimum is aggregated and written, then joined back, so that adaptive execution can split a hub.
    Rounds go on until nothing changes; their number grows with the logarithm of the nodes, so MOST_ROUNDS means an error.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, f"{folder}/0"), None
    for n in range(1, MOST_ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{folder}/{n}-least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{folder}/{n}-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{folder}/{n}-less")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/{n}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = state
    raise RuntimeError("components didn't converge")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of 0..n-1 along edges a-b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
