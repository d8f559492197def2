"""Connected components of a links table, without leaving the executors.

Alternating large-star and small-star steps: in a large-star every node links
its larger neighbours to its smallest neighbour, in a small-star its smaller
neighbours and itself. Each step is an aggregation (combined on the map side)
and a join; the number of rounds grows with the logarithm of the longest
chain. Every round's links are written to the shared folder, and the rounds
end when a checksum of the links no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.workdir import saved


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """``both``: u, v; for each u its v's on one side are linked to the least
    of u and all its v's."""
    # written first, so that both sides of the join are plain scans whose hot
    # nodes Spark can split
    least = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    joined = both.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of
    ``links`` (a, b)."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = saved(pairs, "links")
    seen = None
    while True:
        # sums wrap around modulo 2**64; the count guards against collisions
        row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == seen or row[0] == 0:
            break
        seen = tuple(row)
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u <> v").distinct()
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False)
        pairs = saved(small.where("u <> v").distinct(), "links")
    return (pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(pairs.select(F.col("v"), F.col("v"))).distinct())
