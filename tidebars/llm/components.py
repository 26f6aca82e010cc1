"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two equi-joins on the edge table; lineage is cut with a reliable checkpoint, and no
vertex or component ever travels to the driver (only a count and a checksum do, to see whether a round changed anything).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest reachable node of every node that has an edge. Self-loops and repeated edges are harmless;
    nodes without an edge do not appear; null ends are dropped. Raises if `rounds` don't settle it."""
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = cut(e)
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now.n == 0 or now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
