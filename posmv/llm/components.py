"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.common import materialize


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """links: columns a and b of one type. Return node and root, the least node of its component, for every
    node with a link.

    Each round links every node's larger neighbours to the least of its neighbourhood, then the smaller ones;
    the number of links never grows, and it ends when a round changes nothing. Links stay in the shared
    folder between the rounds; only a count and a checksum reach the driver. Null ends and self-links are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()
    edges = materialize(edges, "links")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # Every link now points from the larger to the smaller node: the smaller neighbours meet at the least.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
