"""Connected components of a table of links, by stars.

Alternating stars: every node sends its larger neighbours to its smallest neighbour, then its smaller ones, until all links are stars
around the smallest node of each component. Each round is a few joins on node ids; minima are reduced in tasks first and
stored, so adaptive execution can split a node with very many links. Rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import checkpoint


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger node has one link and is no other link's smaller node."""
    ends = links.selectExpr("low as node", "1 as below", "0 as above").unionByName(links.selectExpr("high as node", "0 as below", "1 as above"))
    seen = ends.groupBy("node").agg(F.max("below").alias("below"), F.sum("above").alias("above"))
    return seen.where("above > 1 or (above > 0 and below > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b) but the smallest of each component; component is that smallest node."""
    ordered = links.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    stars = checkpoint(ordered.distinct())
    while not _are_stars(stars):
        both = stars.selectExpr("low as node", "high as other").unionByName(stars.selectExpr("high as node", "low as other"))
        least = checkpoint(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least")))
        large = checkpoint(both.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high"))
                           .where("low != high").distinct())
        small = checkpoint(large.groupBy("high").agg(F.min("low").alias("least")))
        met = large.join(small, "high")
        stars = checkpoint(met.select(F.col("least").alias("low"), "high").unionByName(
            met.where("low != least").select(F.col("least").alias("low"), F.col("low").alias("high"))).distinct())
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links (a, b) between nodes: only components are linked, not all nodes again."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = checkpoint(components(checkpoint(between)))
    above = merged.withColumnRenamed("node", "_old").withColumnRenamed("component", "_new")
    moved = labels.join(above, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    return moved.unionByName(merged)
