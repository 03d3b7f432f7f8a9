"""Connected components of a graph given as links, by alternating large-star and small-star rounds.

A round replaces every link by links to the smallest neighbour; the number of links never grows, and a hub's links are only
aggregated (partially, before the shuffle) or joined on the hub, where adaptive execution splits the larger side. Rounds are
written to the shared folder, so a lost executor costs one round at most and no lineage builds up.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidesift.operators.staging import stage


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) for every other node of each component of the links a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = links.select(F.explode(F.array(
        F.struct(F.col("low").alias("node"), F.col("high").alias("next")),
        F.struct(F.col("high").alias("node"), F.col("low").alias("next")))).alias("e")).select("e.*")
    least = both.groupBy("node").agg(F.min("next").alias("least"))
    found = both.join(least, "node").where("next > node")
    return found.select(F.least("least", "node").alias("low"), F.col("next").alias("high")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    found = links.join(least, "high").select("least", F.explode(F.array("low", "high")).alias("node"))
    return found.where("node > least").select(F.col("least").alias("low"), F.col("node").alias("high")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: (low, high) with low < high, any orderable type. Returns (node, root) for every node but the roots.

    Nodes without a link do not appear. An empty input gives no rows. Repeated links are harmless.
    """
    def weight(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())

    links = stage(links.select("low", "high").distinct(), "links")
    before = weight(links)
    while before[0]:
        links = stage(_small_star(_large_star(links)), "links")
        after = weight(links)
        if after == before:
            break
        before = after
    return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
