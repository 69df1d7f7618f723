"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as (node, smallest node of its component), without the smallest ones.

    At most one row for each node, whatever the number of links.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (root[x], root[y], x, y):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _stamp(links: DataFrame) -> tuple:
    """Tells whether two rounds gave the same links."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't the smallest of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    its smallest neighbour; the rounds end when they change nothing (about the
    logarithm of the longest chain). Every round is a written table, so a lost
    executor costs one round at most. Joins by a node with very many neighbours
    are sort-merge joins that Spark can split.
    """
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    stamp = _stamp(now)
    while stamp[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_low"))
        hung = large.join(low, "a").where("b != _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        now = written(hung.union(low.select("a", F.col("_low").alias("b"))).where("a != b").distinct(), "links")
        last, stamp = stamp, _stamp(now)
        if stamp == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
