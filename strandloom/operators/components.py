"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, component): the smallest node each can reach.

    Alternates the large-star and small-star steps: every round hooks each node's neighbours to the smallest node in
    sight, so paths shorten by a factor and a long chain needs a logarithmic number of rounds. Each round is written
    to the shared folder, and only two sums come to the driver. Joins are on plain keys, so AQE can split hubs.
    An empty input gives an empty result; nodes without edges do not appear.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        last, pairs = pairs, written(small.where("u <> v").distinct(), "stars")
        discard(last)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
