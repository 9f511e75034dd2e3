"""Validators: (code, record_id, message) rows, none where the data is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, code: str, record_id: str, message: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(record_id).alias("record_id"), (F.lit("") if message is None else message).alias("message"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def duplicates(df: DataFrame, key: str, code: str = "duplicate_id") -> DataFrame:
    return issues(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), code, key, F.col("n").cast("string"))


def unresolved(df: DataFrame, key: str, reference: str, target: DataFrame, target_key: str, workspace: str = "workspace_id") -> DataFrame:
    """reference_unresolved and cross_workspace_reference of one foreign key; null references are fine."""
    t = target.select(F.col(target_key).alias("_key"), F.col(workspace).alias("_ws")).distinct()
    both = df.where(F.col(reference).isNotNull()).join(t, F.col(reference) == F.col("_key"), "left")
    code = F.when(F.col("_key").isNull(), "reference_unresolved").when(F.col("_ws") != F.col(workspace), "cross_workspace_reference")
    return both.withColumn("code", code).where("code is not null").select("code", F.col(key).alias("record_id"), F.col(reference).alias("message"))


def wrong_hash(df: DataFrame, key: str, value: str, digest: str) -> DataFrame:
    return issues(df.where(F.sha2(F.col(value).cast("binary"), 256) != F.col(digest)), "hash_mismatch", key, F.col(digest))


def not_contiguous(df: DataFrame, group: str, sequence: str, key: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(group).orderBy(sequence)) - 1
    return issues(df.withColumn("_n", n).where(F.col("_n") != F.col(sequence)), "sequence_not_contiguous", key, F.col(sequence).cast("string"))


def not_exactly_one(df: DataFrame, key: str, *columns: str) -> DataFrame:
    given = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return issues(df.where(given != 1), "exactly_one_required", key, given.cast("string"))


def outside_domain(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    return issues(df.where(~F.col(column).isin(allowed)), "value_not_allowed", key, F.col(column))


def illegal_transitions(steps: DataFrame, key: str, before: str, after: str, allowed: set[tuple[str, str]]) -> DataFrame:
    pair = F.concat_ws(">", before, after)
    return issues(steps.where(~pair.isin([f"{a}>{b}" for a, b in sorted(allowed)])), "illegal_transition", key, pair)


def require_empty(found: DataFrame) -> None:
    """Raise if there is an issue; names the first."""
    if first := found.first():
        raise ValueError(f"{first['code']}: {first['record_id']} {first['message']}")


def verdict(checks: DataFrame, group: str) -> DataFrame:
    """(group, status) of checks with status and severity: failed, needs_review, partial or complete."""
    def any_(condition: Column) -> Column:
        return F.max(condition.cast("int")) == 1

    bad, material = F.col("status") == "fail", F.col("severity") == "material"
    return checks.groupBy(group).agg(
        F.when(any_(bad & material), "failed").when(any_(bad), "needs_review").when(any_(F.col("status") == "not_observed"), "partial").otherwise("complete").alias("status"))
