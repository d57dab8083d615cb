"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its neighbours; the aggregate combines before the shuffle, the join may be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every end of a link; component is the smallest id reachable.

    Null ends and loops are ignored; no links give an empty table. Each round is checkpointed, and the rounds
    grow with the logarithm of the longest path. Nothing is gathered on the driver.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stepped = _least_neighbour(large)
        small = stepped.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stepped.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        e = cut(small)
        twice = e.groupBy("u").count().where("count > 1").select("u")
        inner = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if twice.unionByName(inner).isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
