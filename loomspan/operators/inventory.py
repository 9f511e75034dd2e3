"""A global chronological sequence without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chronological(df: DataFrame, keys: list[str], name: str = "chronological_sequence") -> DataFrame:
    """df with a number from 1 in the order of the keys.

    Rows are numbered within ranges of the leading key, and the ranges' counts are added up: one row for each
    distinct value of the leading key's bucket is all that a single task sorts.
    """
    lead = keys[0]
    bucket = F.floor(F.col(lead) / 3600).alias("_bucket")
    own = df.withColumn("_bucket", bucket)
    counts = own.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return own.withColumn("_within", within).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_n", "_before", "_within")
