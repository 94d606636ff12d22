"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriparity.session import cut_lineage


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over the links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        go = root[a] != root[b]
        a, b = a[go], b[go]
    return root


def oriented(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (columns a, b): the smallest id reachable.

    Each round every point takes its smallest neighbour as parent, parents are followed to their roots by
    doubling, and the links between different roots are what is left.  A point with very many links is
    summed before it is shuffled, and the joins are ones that adaptive execution can split.
    """
    edges = cut_lineage(oriented(links))
    points = edges.select(F.col("low").alias("id")).union(edges.select("high")).distinct()
    labels = points.withColumn("component", F.col("id"))
    while not edges.isEmpty():
        parents = cut_lineage(edges.groupBy(F.col("high").alias("v")).agg(F.min("low").alias("p")))
        while True:
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = cut_lineage(parents.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), "q"))
            parents = jumped.select("v", "p")
            if jumped.where("q IS NOT NULL").isEmpty():
                break
        for end in ("low", "high"):
            to = parents.select(F.col("v").alias(end), "p")
            edges = edges.join(to, end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        to = parents.select(F.col("v").alias("component"), "p")
        labels = labels.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        edges = cut_lineage(oriented(edges.select(F.col("low").alias("a"), F.col("high").alias("b"))))
    return cut_lineage(labels)
