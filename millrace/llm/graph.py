"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns node, component (the smallest node reachable) for every node of an edge.

    Each step keeps at most as many edges as there were and is written to the shared folder; the driver
    sees only a count and a checksum, taken while it is written (a task that ran twice can make them
    differ once more, which costs a step). Hubs are reduced with a map-side minimum first.
    """

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def kept(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        rows = written(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        return rows, tuple(sorted(seen.get.items()))

    now, mark = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while mark != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = star(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new, mark = kept(small.distinct())
        discard(now)
        now = new
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
