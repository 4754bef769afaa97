"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, and the edges of each
round are written to the shared folder, so nothing is collected and lost
executors cost one round at most.  A hub is one key whose minimum combines
map-side; its rows join through a sort-merge join that adaptive execution can
split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that occurs in a link."""
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stored(links.select(u.alias("u"), v.alias("v")).where("u > v").distinct(), "edges")
    before = _fingerprint(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(small.where("u > v").distinct(), "edges")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    own = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(own, "u", "left_anti").select("u", F.col("u").alias("component"))
    return own.unionByName(roots).withColumnRenamed("u", "node")
