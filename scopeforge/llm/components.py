"""Connected components: in a task's arrays, and of an edge table by star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeforge.session import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node connected with each."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return node, node[label]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node connected with each node of an edge.

    Rounds of a large star (every larger neighbour of a node to the smallest one) and a
    small star (the node and its smaller neighbours to the smallest one), until the edges
    stay as they are: then each points from a node to its component's smallest.  The
    number of rounds grows with the logarithm of the longest chain.  The smallest neighbours
    are a table before they are joined, so that Spark splits the neighbours of a hub."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = materialize(now, "components")
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            break
        state = mark
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u > v").distinct(), "component-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "component-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "components")
    low = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(low)
