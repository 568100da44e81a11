"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, skew_join


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of comparable ids -> (node, root): root is the smallest node of the component.

    Every round is written to the shared folder.  Hot nodes are split by adaptive execution in the joins; the minima
    are aggregated in the map tasks first.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialise(skew_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = skew_join(large, least, ["a"])
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        new = materialise(small, "links")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            nodes = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        edges = new
