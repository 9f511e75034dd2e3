"""Chunks of a bounded size that never split a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_size(messages: DataFrame, most: int, group: str = "conversation_id", order: str = "sequence", size: Column | None = None) -> DataFrame:
    """(group, order, chunk_no, oversize): messages are taken greedily in order; one that is too large alone is a chunk of its own."""
    size = F.length("text") if size is None else size
    lists = messages.select(group, order, size.cast("long").alias("size")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "size"))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("numbers"))

    def take(state: Column, m: Column) -> Column:
        opens = (state["used"] > 0) & (state["used"] + m["size"] > most)
        no = F.when(opens, state["no"] + 1).otherwise(state["no"])
        return F.struct(no.alias("no"), F.when(opens, m["size"]).otherwise(state["used"] + m["size"]).alias("used"), F.concat(state["numbers"], F.array(no)).alias("numbers"))

    numbered = lists.withColumn("numbers", F.aggregate("m", start, take, lambda s: s["numbers"]))
    rows = numbered.select(group, F.explode(F.arrays_zip("m", "numbers")).alias("x"))
    return rows.select(group, F.col(f"x.m.{order}").alias(order), F.col("x.numbers").alias("chunk_no"), (F.col("x.m.size") > most).alias("oversize"))
