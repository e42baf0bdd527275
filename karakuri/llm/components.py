"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut


def star_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges between longs -> (node, root), root the smallest node reachable; nodes that are roots are absent.

    Every round rewires edges to the smallest neighbour, so the depth halves about each time. Rounds go through the
    shared checkpoint folder; only a count and a checksum reach the driver. Self-loops and nulls are dropped, an empty
    edge table gives an empty result.
    """
    cur = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        cur = cut(small)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if seen == now:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
