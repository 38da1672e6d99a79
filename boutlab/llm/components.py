"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.sources.tables import stage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours to its least
    one, then every node links all smaller neighbours, itself included, to the least. Both keep
    components whole, the number of rounds grows with the logarithm of the longest chain, and a
    neighbour list is only ever aggregated, never gathered. Each round is written to the shared
    folder, which cuts the lineage.
    """
    # Written before it is read twice; making links is the dear part.
    links = stage(links, "links")
    edges = stage(_both_ways(links).filter("a > b").distinct(), "links")
    before = None
    while True:
        large = _link_to_least(_both_ways(edges), "n > node")
        small = stage(_link_to_least(large, "true"), "links")
        now = small.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        edges = small
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(own)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")


def _link_to_least(edges: DataFrame, which: str) -> DataFrame:
    """For every node the pairs (neighbour, least of node and neighbours), larger end first."""
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("n"))
    least = named.groupBy("node").agg(F.least(F.min("n"), F.col("node")).alias("least"))
    # Stored, so that the neighbours of a hot node can be split over tasks.
    linked = named.join(stage(least, "least"), "node")
    to_least = linked.filter(which).select(F.col("n").alias("a"), F.col("least").alias("b"))
    own = linked.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return to_least.union(own).filter("a > b").distinct()
