"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardmill.llm.common import stored, superseded


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); the root is the component's least node.

    Alternates two steps until nothing changes: every node hands its greater neighbours
    to its least one, then its lesser neighbours. Each step keeps components whole and
    the number of links no larger than the number of nodes allows; the number of rounds
    grows with the logarithm of the longest path. A node that all others
    link to is only ever aggregated by ``min`` and joined, so it is split over tasks.
    Each round is written to the shared folder, and one row of sums comes to the driver.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        # Greater neighbours: seen from every end of every link.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Lesser neighbours: each link seen from its greater end.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        done = edges
        edges = stored(small.filter("a <> b").distinct(), "links")
        superseded(done)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))
        ).head()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
