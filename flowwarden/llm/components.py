"""Connected components by alternating stars; links stay in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwarden.llm.common import stored


def _stars(links: DataFrame) -> bool:
    """Does every node hang below one parent, which hangs below none?"""
    ends = links.groupBy("node").agg(F.count("*").alias("n")).select("node", "n", F.lit(False).alias("above"))
    tops = links.select(F.col("parent").alias("node")).distinct().select("node", F.lit(0).alias("n"), F.lit(True))
    seen = ends.union(tops).groupBy("node").agg(F.sum("n").alias("n"), F.max("above").alias("above"))
    return seen.where("n > 1 OR (n = 1 AND above)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b. Returns node, component: the smallest node reachable, for
    every node that has a link to another. Null ends and loops are ignored; no edges give
    no rows.

    Each round hangs every node's larger neighbours below the smallest node it knows, then
    its smaller ones; stars are reached in a number of rounds that grows with the logarithm
    of the graph. A hub is many rows: its minimum is pre-aggregated and its links are joined,
    never gathered.
    """
    links = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
    links = stored(links.where("node > parent").distinct(), "links")
    while not _stars(links):
        lowest = (
            links.select("node", "parent")
            .union(links.select(F.col("parent"), F.col("node")))
            .groupBy("node")
            .agg(F.min("parent").alias("low"))
            .select(F.col("node").alias("parent"), F.least("low", "node").alias("low"))
        )
        large = links.join(lowest, "parent").select("node", F.col("low").alias("parent")).distinct()
        lowest = large.groupBy("node").agg(F.min("parent").alias("low"))
        small = (
            large.join(lowest, "node")
            .select(F.explode(F.array(
                F.struct("node", F.col("low").alias("parent")),
                F.struct(F.col("parent").alias("node"), F.col("low").alias("parent")),
            )).alias("link"))
            .select("link.node", "link.parent")
            .where("node > parent")
            .distinct()
        )
        links = stored(small, "links")
    roots = links.select(F.col("parent").alias("node")).distinct()
    return links.select("node", F.col("parent").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
