"""Connected components of a table of edges, by rounds of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import tables


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node reached.

    Each round takes the smallest label among a node's neighbours, then follows labels
    one step (the label of the label), so chains shrink geometrically. Labels are written
    to the shared folder each round; only the number of changes comes to the driver. Nodes
    with very many edges, and labels of very many nodes, are looked up by broadcast.
    """
    a, b = F.col("a"), F.col("b")
    both = edges.filter(a != b).select(a, b).unionByName(edges.filter(a != b).select(b.alias("a"), a.alias("b"))).distinct()
    both = tables.cut(spark, both, "edges")
    n_edges = both.count()
    labels = both.groupBy(a.alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("node", F.least("node", "m").alias("root"), "_n")
    labels = tables.cut(spark, labels, "labels")
    n_nodes = labels.count()
    while True:
        near = tables.attach(both, labels.withColumnRenamed("node", "b"), ["b"], n_edges).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"), "_n")
        lower = tables.cut(spark, lower, "lower")
        held = lower.groupBy("root").agg(F.count("*").alias("_held"))
        jump = held.join(labels.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").withColumnRenamed("_held", "_n")
        moved = tables.attach(lower.withColumnRenamed("_n", "_degree"), jump, ["root"], n_nodes)
        moved = tables.cut(spark, moved.select("node", "old", F.least("root", "above").alias("root"), F.col("_degree").alias("_n")), "labels")
        labels = moved.select("node", "root", "_n")
        if moved.filter(F.col("root") != F.col("old")).isEmpty():
            return labels.drop("_n")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reached from each of n nodes over edges held in arrays."""
    roots = np.arange(n)
    while True:
        before = roots.copy()
        least = np.minimum(roots[a], roots[b])
        np.minimum.at(roots, a, least)
        np.minimum.at(roots, b, least)
        roots = np.minimum(roots, roots[roots])
        if np.array_equal(roots, before):
            return roots
