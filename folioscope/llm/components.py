"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each round joins links with the smallest neighbour of a node; rounds grow with the logarithm of a component's size.  The
smallest neighbour is a partial aggregate.  Nodes of `HOT` links or more are joined by broadcast of a bounded number of rows
(see `join_counted`), so no task gathers a star; the rest by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, materialize

HOT = 256


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of a link (a, b); nodes are of any orderable type."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if not edges.head(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = None
    while True:
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), small=False)
        small = _star(large, small=True)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, large)
        edges = small
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links from each neighbour to the smallest of a node and its neighbours.  Large: neighbours above the node, of
    links in both directions; small: links from a node to lower ones, and from the node itself."""
    least = materialize(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "w"), "cc-least")
    joined = join_counted(edges, least, "u", "w", "n", HOT)
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = out.where("u <> v")
    out = materialize(out.distinct() if small else out, "cc")  # repeated links do no harm to the star that follows
    discard(least)
    return out
