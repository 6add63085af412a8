"""Connected components of a graph of links, by alternating star operations on distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b, of one orderable type): root is the least node reachable.

    Each round points the larger neighbours of every node, then the smaller ones, at the least neighbour; rounds
    are about the logarithm of the longest chain. Repeats and both directions of a link are fine. Links with a
    null end or from a node to itself are left out, and nodes that have no others. Each round's table is written to the shared folder. A hub's rows are pre-aggregated for its
    minimum and joined with that one row, where Spark splits skewed partitions.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b and a is not null and b is not null").distinct()
    links, seen = materialize(links), None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if mark == seen or not mark["n"]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        # larger neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        links = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # smaller neighbours
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = links.join(least, links["a"] == least["u"])
        links = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = materialize(links.where("a != b").distinct())
