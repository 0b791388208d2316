"""Connected components of a table of links, by stars that grow and merge."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlake.llm.shared import stored


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component, of n members and links from i to j."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (the smaller ones, or all) joined to the least of them and itself."""
    both = edges if small else edges.unionByName(
        edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.min("to").alias("low")).withColumn(
        "low", F.least("low", "node"))
    met = both.join(least, "node")
    if small:
        moved = met.select(F.col("to").alias("node"), F.col("low").alias("to")).unionByName(
            least.select("node", F.col("low").alias("to")))
    else:
        moved = met.where("to > node").select(F.col("to").alias("node"), F.col("low").alias("to"))
    return moved.where("node > to").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for each node that is not its root.

    ``edges`` has node and to, of one orderable type. Large and small stars alternate until nothing
    changes; each round is written to the shared folder, and only its checksum reaches the driver.
    """
    edges = stored(edges.select(
        F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).where(
        "node > to").distinct(), "edges")
    before = None
    while True:
        edges = stored(_star(stored(_star(edges, small=False), "edges"), small=True), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(
            F.xxhash64("node", "to").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select("node", F.col("to").alias("root"))
        before = now
