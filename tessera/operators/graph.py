"""Search along links over several hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """edges: source, target; starts: start. (start, node, depth): all nodes that a start leads to, itself at 0, with the fewest
    hops; within ``most`` hops, or all.

    One round a hop: the nodes found last meet their edges, and what a start has seen is left out by an anti-join. Each
    round is checkpointed; only whether it found something comes to the driver. Repeated and null edges, loops and cycles
    change nothing. A node of many links is one key of the join, which Spark splits where it is skewed."""
    links = checkpointed(edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct())
    front = checkpointed(starts.filter("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    rounds = [front]
    while most is None or len(rounds) <= most:
        seen = reduce(DataFrame.unionByName, rounds).select("start", "node")
        found = front.join(links, front["node"] == links["source"]).select("start", F.col("target").alias("node")).distinct()
        front = checkpointed(found.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(len(rounds))))
        if front.isEmpty():
            break
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)
