"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, small


def _towards_minimum(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """pairs (u, v): each v of a node u becomes linked to the smallest of u and its partners.

    keep_own: link u itself to that smallest one, too (small star)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    linked = pairs.join(least, "u")
    if keep_own:
        own = least.filter("u > low").select("u", F.col("low").alias("v"))
        return linked.filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(own)
    return linked.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all edges (u, v) of a bounded table: node and root."""
    pairs = [np.stack([c.to_numpy() for c in b.columns], axis=1) for b in batches]
    node, at = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(node))
    while True:  # labels fall to the smallest neighbour, and each then to the label of its label
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            break
        root = low
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])


def connected_components(edges: DataFrame, a: str, b: str, at_once: int = 0) -> DataFrame:
    """node and root (the smallest node of its component) of each node that has an edge to another one.

    Each round is checkpointed and is a few equi-joins on the node; rounds grow with the logarithm of the longest path.
    The state stays distributed: only a count and a checksum reach the driver. at_once: nodes are long, and up to so many
    edges are joined in one task instead of rounds, each of which would cost several small jobs."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    if at_once:
        now = checkpoint(now)
        if small(now, at_once):
            return now.coalesce(1).mapInArrow(_of_few, "node long, root long")
    now = checkpoint(now.distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_minimum(both, keep_own=False).distinct()
        now = checkpoint(_towards_minimum(large, keep_own=True).distinct())
        # in a forest of stars each round gives the same edges again
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == (row[0], row[1]):
            break
        mark = (row[0], row[1])
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
