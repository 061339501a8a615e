"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletools.sources.staging import stage


def _lean_to_larger(links: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the smallest around that node."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b")


def _lean_to_smaller(links: DataFrame) -> DataFrame:
    """Each neighbour below a node, and the node, are linked to the smallest below it. ``links``: a below b."""
    least = links.groupBy("b").agg(F.min("a").alias("low"))
    below = links.join(least, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return below.unionByName(least.select(F.col("low").alias("a"), "b"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b: two different values of one orderable type) that is not the smallest of
    its component; ``root`` is. Links are exchanged for links to smaller nodes, in steps that each are written
    to the shared folder, until every component is a star. The steps grow with the logarithm of the nodes.
    """
    links = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
        links = stage(_lean_to_smaller(_lean_to_larger(links).distinct()).distinct(), "links")
