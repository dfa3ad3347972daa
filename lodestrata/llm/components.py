"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.storage import stored


def least_places(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is linked to, in memory; links (low, high) are places."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, high, root[low])
        np.minimum.at(new, low, root[high])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node it sees."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: different longs); root is the least node it is linked to.

    Each round is written to the shared folder and read back. The number of rounds grows with the logarithm
    of the longest chain. An empty table gives an empty result.
    """
    now, before = stored(edges.distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges", replaces=now)
