"""Connected components: few edges on the driver, more by iterative joins; nothing of a component meets in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_sized


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the edges (a, b), sorted, and the smallest id that each reaches."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(ids)), ends.reshape(2, -1)
    while True:
        x, y = root[x], root[y]
        x, y = np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if not len(x):
            return ids, ids[root]
        np.minimum.at(root, x, y)  # a root points to a smaller one, so there are no rings
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, scratch: Scratch, tag: str, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each end of ``edges`` (a, b) reaches; ``edges`` is read twice, so it should be a table.

    Up to BROADCAST_ROWS edges (counted) are joined on the driver, for a round of
    joins costs the same however few they are.

    Beyond it, alternating large-star and small-star: every round links the
    larger neighbours of a node to the smallest known one, then the smaller ones.
    The edges end as stars: each larger end has one neighbour only, which the
    degrees that a round begins with tell.  A hub's neighbours are never gathered:
    its minimum is an aggregation that combines before the shuffle, and its rows
    are dealt to as many tasks as they need where it meets them.

    Loops and repeated edges count once; a null end is no edge; without edges
    there are no rows.  A chain of n nodes settles in about log2(n) rounds, so
    ``rounds`` is reached by no table; were it, the call fails rather than
    return parts of components.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    if edges.count() <= BROADCAST_ROWS:
        held = edges.toArrow()
        ids, root = least_reached(held.column("a").to_numpy(), held.column("b").to_numpy())
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(root, pa.int64())}), "id long, root long")
    edges = scratch.put(edges.distinct(), f"{tag}_0")
    for i in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.put(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")), f"{tag}_{i}_large")
        if not least.where("m < a and n > 1").limit(1).count():
            scratch.drop(f"{tag}_{i}_large")
            break
        large = join_sized(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.put(large, f"{tag}_{i}_l")
        # Small star: a node and its smaller neighbours link to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = scratch.put(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{tag}_{i}_small")
        small = join_sized(down, least, ["a"], "n")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = scratch.put(small, f"{tag}_{i}")
        for name in (f"{tag}_{i}_large", f"{tag}_{i}_l", f"{tag}_{i}_small", f"{tag}_{i - 1}"):
            scratch.drop(name)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
