"""Connected components of an edge table by alternating large-star and small-star steps.

Each step links nodes to their smallest neighbour, so paths become stars in logarithmically many rounds. A step is one
aggregation, combined before the shuffle, and one join with its written result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long). Returns node, root for every node with an edge to another one; root is the smallest."""
    now = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k"))
        large = stash(both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        moved = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = stash(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
