"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlake.llm.common import discard, materialize


def smallest(edges: DataFrame) -> DataFrame:
    """edges with low, the smallest neighbour of a (a itself included). The minima are a table of their own, so that a node of very many edges can be split in the join."""
    low = materialize(edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "stars")
    return edges.join(low, "a")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for all nodes of edges (a, b longs). Rounds go on until nothing changes.

    A null or self edge counts for nothing; an empty table has no nodes.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, was = materialize(own.distinct(), "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first()
        if state == was:
            break
        was = state
        # large star: larger neighbours go to the smallest one
        both = now.union(now.select("b", "a"))
        large = smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        # small star: the node and its smaller neighbours go to the smallest one
        at = smallest(large)
        small = at.select(F.col("b").alias("a"), F.col("low").alias("b")).union(at.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        old, now = now, materialize(small, "edges")
        discard(old)
        discard(large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct().toDF("node", "root"))


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives rows that the pairs (i, j) connect the same label, the smallest row number, in place."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
