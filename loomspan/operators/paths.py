"""Paths up a tree by pointer doubling: a round of joins doubles how far every node sees, so no conversation is gathered.

nodes has conversation_id, node_id and parent_id; a parent that is not among a conversation's nodes counts as none.  Nodes on a cycle, and
those that hang from one, never reach a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def _linked(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, up): up is the parent, where there is one."""
    known = nodes.select("conversation_id", F.col("node_id").alias("up")).distinct()
    return nodes.select("conversation_id", "node_id", F.col("parent_id").alias("up")).join(known.withColumn("there", F.lit(True)), ["conversation_id", "up"], "left") \
        .select("conversation_id", "node_id", F.when(F.col("there"), F.col("up")).alias("up"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Tables of (conversation_id, node_id, up): the ancestors 1, 2, 4, … steps up; the last one has none but for cycles."""
    out = [written(_linked(nodes), "up")]
    most = nodes.groupBy("conversation_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        j = out[-1]
        if j.where("up is not null").isEmpty():
            break
        further = j.select("conversation_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        out.append(written(j.join(further, ["conversation_id", "up"], "left").select("conversation_id", "node_id", F.col("next").alias("up")), "up"))
    return out


def rooted(found: list[DataFrame]) -> DataFrame:
    """(conversation_id, node_id, reaches_root) by the levels of a tree."""
    return found[-1].select("conversation_id", "node_id", F.col("up").isNull().alias("reaches_root"))


def ancestors(found: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(conversation_id, node_id) of all nodes on the way up from starts, themselves included: from the largest step down, every set of nodes adds what is so many steps above it."""
    path = starts.select("conversation_id", "node_id").join(found[0].select("conversation_id", "node_id"), ["conversation_id", "node_id"], "left_semi").distinct()
    for level in reversed(found):
        above = path.join(level, ["conversation_id", "node_id"]).where("up is not null").select("conversation_id", F.col("up").alias("node_id"))
        path = written(path.unionByName(above).distinct(), "path")
    return path


def message_ancestors(nodes: DataFrame) -> DataFrame:
    """(conversation_id, node_id, message_ancestor): the nearest node above that has a message."""
    has = nodes.select("conversation_id", F.col("node_id").alias("up"), F.col("has_message"))
    told = _linked(nodes).join(has, ["conversation_id", "up"], "left").select("conversation_id", "node_id", "up", F.coalesce(F.col("up").isNull() | F.col("has_message"), F.lit(False)).alias("done"))
    most = nodes.groupBy("conversation_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    told = written(told, "ancestors")
    for _ in range(most.bit_length()):
        if told.where("not done").isEmpty():
            break
        further = told.select("conversation_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"))
        met = told.where("not done").join(further, ["conversation_id", "up"]).select("conversation_id", "node_id", F.col("next").alias("up"), F.col("next_done").alias("done"))
        told = written(told.where("done").unionByName(met), "ancestors")
    return told.select("conversation_id", "node_id", F.when(F.col("done"), F.col("up")).alias("message_ancestor"))
