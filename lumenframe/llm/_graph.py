"""Connected components by alternating stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._common import saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its smallest node.

    Large star: each node links its larger neighbours to its smallest one. Small star: each node links its
    smaller neighbours and itself to the smallest. Rounds go on until the forest of stars stands still,
    logarithmically many in the length of the longest path. Each round's edges are a saved table. Beyond ``most_rounds`` it raises.
    """
    u, v = F.col("u"), F.col("v")
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u != v).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    stars = now.select(u.alias("node"), v.alias("component"))
    return stars.unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
