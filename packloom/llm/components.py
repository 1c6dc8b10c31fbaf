"""Connected components of an edge list, by repeated star contraction on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.plans.stash import join_lookup, scratch, stash


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member index of each of ``n`` items' component under edges (a, b)."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _is_star_forest(at: DataFrame, n: int) -> bool:
    """Whether each of ``n`` children has one parent and no parent is a child."""
    parents = at.select(F.col("b").alias("a")).distinct()
    return n == at.select("a").distinct().count() and at.join(parents, "a", "left_semi").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp) of every id in ``edges`` (a, b): comp is the least id that a chain of edges reaches.

    Alternates large-star and small-star steps, each a grouped minimum and a join on ids, until every child hangs on a
    root; the number of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    The edges of a hub are not brought together: they read its minimum from a broadcast of bounded size.
    """
    with scratch(edges.sparkSession):
        at = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        for _ in range(most_rounds):
            n = at.count()
            if _is_star_forest(at, n):
                named = at.select(F.col("a").alias("id"), F.col("b").alias("comp"))
                return stash(named.unionByName(at.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()), outer=True)
            both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree")))
            # large star: neighbours above a node hang on the node's least neighbour
            large = join_lookup(both, least, "a", "degree", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = stash(large)
            # small star: a node and its lower neighbours hang on the least of them
            low = stash(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")))
            hung = join_lookup(large, low, "a", "degree", n)
            hung = hung.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b")
            at = stash(hung.distinct())
    raise RuntimeError("components did not settle")
