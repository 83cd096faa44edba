"""Connected components of an edge table, by stars that alternate between larger and smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: long); loops and repeated edges are allowed.

    Each round groups edges by node for the smallest neighbour (combined before the shuffle) and joins it back, so a
    node with very many edges never meets in one task; the number of rounds grows with the logarithm of the nodes.
    Rounds are written to the shared folder.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        now = keep(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
