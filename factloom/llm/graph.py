"""Connected components of a distributed edge list, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another: their number and two sums of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    Alternates large-star and small-star steps: each node links its larger
    neighbours, then its smaller ones, to the smallest node it knows. The number
    of edges never grows and a path halves with each round. A hub's edges are aggregated before they
    are shuffled and meet its least neighbour in a plain equality join, whose skewed
    keys Spark splits at run time. Each round's edges are written to the shared folder.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    now = materialise(now, "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        ).distinct()
        after = materialise(small, "edges")
        discard(now)
        now, before, state = after, state, _state(after)
        if before == state:
            return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
