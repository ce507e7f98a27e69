"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Adds to each row (u, v) the least of u and all its v. The minimum is combined before the shuffle; a hub's rows can be split by the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs["u"] == least["k"]).drop("k")


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the least node that can be reached.

    Edges need no order and may repeat; a null end or a loop links nothing. Each round is two grouped minima and two
    equi-joins over the edges alone; the rounds end when the sum of the table no longer changes. A table without edges
    gives an empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = scratch.keep(now.distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _least_neighbour(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        later = scratch.keep(small)
        scratch.drop(now)
        now = later
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
