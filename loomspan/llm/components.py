"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and two joins over the edges; no component, and
no node's neighbourhood, is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges hold u > v.  A node hands its least neighbour to its larger (or smaller) neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the least node.

    Nulls and self-loops are ignored; an empty edge table gives an empty result.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, was = Table(start, "cc"), None
    while True:
        mark = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was:
            break
        was, old = mark, now
        now = Table(_star(_star(old.df, True), False), "cc")
        old.drop()
    found = now.df
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (a, b) of known components and further links: stars, on which `components` needs few rounds."""
    return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b"))
