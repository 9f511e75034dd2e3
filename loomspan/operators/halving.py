"""Parts of bounded size: an oversized part is halved between its messages until every part fits or is one message.

A part's reference tells its way down (``chunk0001__sub0002__sub0001``).  Every level is one aggregation by part and one
join back, so no part is gathered; what fits leaves the loop.  What parts say is brought together by putting
their reference before each local one, and links whose ends are not both there are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

FITS, SINGLE, DEPTH = "fits", "single_message", "split_depth_limit"


def split(messages: DataFrame, bound: int, max_depth: int = 32) -> DataFrame:
    """(conversation_id, sequence, part_ref, part_size, status) of (conversation_id, sequence, size) messages.

    The first half ends before the message that begins at or beyond half the part's size, and always before the last message.  A message of
    more than the bound ends up alone; at max_depth a part is left as it is.
    """
    before = F.sum("size").over(Window.partitionBy("conversation_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1))
    open_parts = written(messages.select("conversation_id", "sequence", F.col("size").cast("long").alias("size"), F.coalesce(before, F.lit(0)).cast("long").alias("before"),
                                         F.lit("chunk0001").alias("part_ref")), "parts")
    done = None
    for depth in range(max_depth + 1):
        parts = open_parts.groupBy("conversation_id", "part_ref").agg(
            F.sum("size").alias("part_size"), F.count("*").alias("n"), F.min("before").alias("start"), F.max("sequence").alias("last"))
        status = F.when(F.col("part_size") <= bound, FITS).when(F.col("n") == 1, SINGLE)
        if depth == max_depth:
            status = F.coalesce(status, F.lit(DEPTH))
        told = written(open_parts.join(parts.withColumn("status", status), ["conversation_id", "part_ref"]), "parts")
        settled = told.where("status is not null").select("conversation_id", "sequence", "part_ref", "part_size", "status")
        done = settled if done is None else done.unionByName(settled)
        rest = told.where("status is null")
        if rest.isEmpty():
            break
        second = (F.col("before") - F.col("start") >= F.ceil(F.col("part_size") / 2)) | (F.col("sequence") == F.col("last"))
        open_parts = rest.select("conversation_id", "sequence", "size", "before", F.concat("part_ref", F.lit("__sub000"), F.when(second, "2").otherwise("1")).alias("part_ref"))
    return done


def merged(observations: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations (conversation_id, part_ref, ref, …) and links (conversation_id, part_ref, from_ref, to_ref, …) of all parts under one set of references."""
    known = observations.select("conversation_id", "part_ref", "ref").distinct()
    for end in ("from_ref", "to_ref"):
        links = links.join(known.withColumnRenamed("ref", end), ["conversation_id", "part_ref", end])

    def whole(name: str):
        return F.concat("part_ref", F.lit("__"), name)

    return observations.withColumn("ref", whole("ref")), links.withColumn("from_ref", whole("from_ref")).withColumn("to_ref", whole("to_ref"))
