"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node that has an edge.

    ``edges``: columns a and b, longs. Alternating stars: every node first hands its larger
    neighbours, then its smaller ones, to its smallest neighbour, until only
    stars are left, in about log n rounds. Minima combine before they are
    shuffled, and the joins are on equal keys, so a node with many neighbours is
    split by adaptive execution.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = keep(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct(), "edges")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = keep(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        found = _state(new)
        if found == state:
            break
        now, state = new, found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
