"""Capture archives: directories of files with a hash list, verified without changing anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_FILE = "hashes.sha256"
_ROW = r"^([0-9a-f]{64})  (.+)$"


def hash_rows(spark: SparkSession, root: str) -> DataFrame:
    """(directory, path, sha256) of every line `<64 hex>  <path>` of the hash lists below a folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", HASH_FILE).text(root).select(
        F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("directory"), "value")
    return rows.select("directory", F.regexp_extract("value", _ROW, 2).alias("path"), F.regexp_extract("value", _ROW, 1).alias("sha256")).where("sha256 <> ''")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """(code, record_id, message) of files that are missing, not listed or not as listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("actual")) \
        .where(~F.endswith("path", F.lit("/" + HASH_FILE)))
    def bare(c):
        return F.regexp_replace(c, r"^[a-z]+:/+", "/")

    listed = hash_rows(spark, root).select(bare(F.concat_ws("/", "directory", "path")).alias("file"), "sha256")
    both = listed.join(files.select(bare(F.col("path")).alias("file"), "actual"), "file", "full")
    code = F.when(F.col("actual").isNull(), "file_missing").when(F.col("sha256").isNull(), "file_not_listed").when(F.col("actual") != F.col("sha256"), "hash_mismatch")
    return both.select(code.alias("code"), F.col("file").alias("record_id"), F.coalesce("sha256", "actual").alias("message")).where("code is not null")


def tree_digest(spark: SparkSession, root: str) -> str | None:
    """One hash of all files: sorted `path` NUL `hash` lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^[a-z]+:/+", "/").alias("p"), F.sha2("content", 256).alias("h"))
    lines = files.select("p", F.concat_ws("\x00", "p", "h").alias("line"))
    return lines.agg(F.expr("sha2(listagg(line, '\n') WITHIN GROUP (ORDER BY p), 256)").alias("d")).first()["d"]


def write_append_only(stored: str, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """Append rows of new keys to a Parquet table; same key and hash is a replay, another hash an error row. Returns (key, outcome)."""
    from ..operators.provenance import insert_or_verify

    spark = incoming.sparkSession
    try:
        old = spark.read.parquet(stored)
    except Exception as error:  # the table's first rows
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = incoming.limit(0)
    outcome = insert_or_verify(old, incoming, key, digest)
    result = outcome.checkpoint() if spark.sparkContext.getCheckpointDir() else outcome.cache()
    result.count()  # fixed before the table changes below it
    incoming.join(result.where("outcome = 'inserted'").select(key), key, "left_semi").write.mode("append").parquet(stored)
    return result
