"""The operation log as a stream: idempotent replay, ordered fold with state, stale operations, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.operations import TERMINAL, transition_map


def fold_stream(events: DataFrame) -> DataFrame:
    """(operation_id, status, error, n_events, last_event_type) of every operation that a micro-batch touched; update mode.

    The state of an operation is its own short log, in the order it came in; it is folded like `operations.fold`, as far as its numbers have no gap.
    Events that come early wait in the log.  Of events of one number the first that came counts, the others are replays.
    """
    table = transition_map()
    logs = events.groupBy("operation_id").agg(F.collect_list(F.struct("event_sequence", "event_type")).alias("log"))
    numbered = F.array_sort(F.transform("log", lambda e, i: F.struct(e["event_sequence"].alias("n"), i.alias("place"), e["event_type"].alias("event"))))
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("string").alias("last"))

    def advance(state: Column, e: Column) -> Column:
        to = F.try_element_at(table, F.concat(state["status"], F.lit(">"), e["event"]))
        error = F.coalesce(state["error"], F.when(to.isNull(), F.concat_ws("", F.lit("invalid_transition:"), e["event"])))
        return F.when(e["n"] == state["seen"] + 1, F.struct(F.when(error.isNull(), to).otherwise(state["status"]).alias("status"), error.alias("error"), (state["seen"] + 1).alias("seen"), e["event"].alias("last"))) \
            .otherwise(state)

    return logs.withColumn("s", F.aggregate(numbered, start, advance)).select(
        "operation_id", F.col("s.status").alias("status"), F.col("s.error").alias("error"), F.col("s.seen").alias("n_events"), F.col("s.last").alias("last_event_type"))


def windowed_counts(events: DataFrame, ts: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, with a watermark for late data; ts is cast, as a zone-less timestamp has no watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")) \
        .select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def without_replays(events: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each (operation, sequence) once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(["operation_id", "event_sequence"])


def stale(status: DataFrame, now_us: int, timeout_s: int) -> DataFrame:
    """capture_interrupted events for open operations without news; status has operation_id, status, n_events, last_event_us."""
    if timeout_s < 60:
        raise ValueError("a timeout is 60 seconds at least")
    old = status.where(~F.col("status").isin(*TERMINAL)).where(F.lit(now_us) - F.col("last_event_us") >= timeout_s * 1_000_000)
    return old.select("operation_id", (F.col("n_events") + 1).alias("event_sequence"), F.lit("capture_interrupted").alias("event_type"), F.lit(now_us).alias("event_us"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of the new snapshot whose fingerprint is new: the change feed."""
    columns = [c for c in after.columns if c != key]

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_f", F.xxhash64(*columns))

    return marked(after).join(marked(before).select(key, "_f"), [key, "_f"], "left_anti").drop("_f")
