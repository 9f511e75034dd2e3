"""Operation events: the state machine, its fold over an ordered log, and status reports."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIFECYCLE = ("operation_created", "pairing_requested", "pairing_succeeded", "identity_observed", "identity_verified", "capture_requested", "capture_started",
             "capture_progress", "collector_delivery_started", "collector_delivery_succeeded", "archive_started", "archive_completed", "verification_completed", "capture_completed")
_OPEN = ("created", "pairing", "prepared", "capturing", "delivering", "archiving", "verifying")
TERMINAL = ("completed", "needs_review", "failed", "interrupted", "canceled")
# The states that an event may follow, and the state it leads to.  "" is the state before the first event.
TRANSITIONS = {
    "operation_created": (("",), "created"),
    "pairing_requested": (("created",), "pairing"),
    "pairing_succeeded": (("pairing",), "prepared"),
    "pairing_failed": (("pairing",), "failed"),
    "identity_observed": (("created", "prepared"), "prepared"),
    "identity_verified": (("prepared",), "prepared"),
    "identity_mismatch": (("created", "prepared", "capturing"), "failed"),
    "capture_requested": (("created", "prepared"), "prepared"),
    "capture_started": (("prepared",), "capturing"),
    "capture_progress": (("capturing",), "capturing"),
    "collector_delivery_started": (("capturing",), "delivering"),
    "collector_delivery_succeeded": (("delivering",), "delivering"),
    "collector_delivery_failed": (("capturing", "delivering"), "failed"),
    "archive_started": (("delivering",), "archiving"),
    "archive_completed": (("archiving",), "archiving"),
    "verification_completed": (("archiving",), "verifying"),
    "capture_completed": (("verifying",), "completed"),
    "capture_needs_review": (("verifying",), "needs_review"),
    "capture_failed": (_OPEN, "failed"),
    "capture_interrupted": (_OPEN, "interrupted"),
    "operation_canceled": (_OPEN, "canceled"),
}


def transition_map() -> Column:
    """(state>event) to the next state."""
    pairs = [(f"{state}>{event}", to) for event, (states, to) in TRANSITIONS.items() for state in states]
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def fold(events: DataFrame) -> DataFrame:
    """(operation_id, status, error, n_events, last_event_type): the log of each operation, replayed in order.

    error is null, "not_contiguous" or "invalid_transition:<event>"; status is that before the error.  A log is an
    operation's own short list of events, so it is folded as one array.
    """
    table = transition_map()
    step = F.struct("event_sequence", "event_type")
    logs = events.groupBy("operation_id").agg(F.array_sort(F.collect_list(step)).alias("log"))
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("seen"))

    def advance(state: Column, event: Column) -> Column:
        to = F.try_element_at(table, F.concat(state["status"], F.lit(">"), event["event_type"]))
        error = F.when(state["error"].isNotNull(), state["error"]).when(event["event_sequence"] != state["seen"] + 1, "not_contiguous") \
            .when(to.isNull(), F.concat(F.lit("invalid_transition:"), event["event_type"]))
        return F.struct(F.when(error.isNull(), to).otherwise(state["status"]).alias("status"), error.alias("error"), (state["seen"] + 1).alias("seen"))

    return logs.withColumn("state", F.aggregate("log", start, advance)).select(
        "operation_id", F.col("state.status").alias("status"), F.col("state.error").alias("error"),
        F.size("log").cast("long").alias("n_events"), F.element_at("log", -1)["event_type"].alias("last_event_type"))


def status_report(events: DataFrame, now_us: int, stale_s: int = 900) -> DataFrame:
    """The folded state with stage flags, the last event, and whether an open operation is stuck."""
    def has(kind: str) -> Column:
        return F.max((F.col("event_type") == kind).cast("int"))

    flags = events.groupBy("operation_id").agg(
        has("capture_started").alias("capture_started"), has("identity_verified").alias("identity_verified"),
        has("collector_delivery_succeeded").alias("delivered"), has("archive_completed").alias("archived"),
        has("verification_completed").alias("verified"), F.max("event_us").alias("last_event_us"))
    terminal = F.col("status").isin(*TERMINAL)
    return fold(events).join(flags, "operation_id").withColumn(
        "stuck", (~terminal & (F.lit(now_us) - F.col("last_event_us") >= stale_s * 1_000_000)).cast("int")) \
        .withColumn("retry_safe", (terminal & ~F.col("status").isin("completed", "needs_review")).cast("int"))


def order_violations(events: DataFrame, now_us: int, skew_s: int = 300) -> DataFrame:
    """(code, record_id, message) of logs that run backwards in time or beyond the allowed skew, or repeat a number."""
    before = F.lag("event_us").over(Window.partitionBy("operation_id").orderBy("event_sequence"))
    n = F.count("*").over(Window.partitionBy("operation_id", "event_sequence"))
    checks = F.array_compact(F.array(
        F.when(F.col("event_us") < F.col("before"), "backward_time"), F.when(F.col("event_us") > now_us + skew_s * 1_000_000, "future_time"), F.when(F.col("n") > 1, "repeated_sequence")))
    return events.withColumn("before", before).withColumn("n", n).select(
        F.explode(checks).alias("code"), F.col("operation_id").alias("record_id"), F.col("event_sequence").cast("string").alias("message"))


# Attempts before a delivery has failed for good, and the longest wait in minutes.
DELIVERY_ATTEMPTS, LONGEST_WAIT_MIN = 20, 30


def delivery(attempts: DataFrame) -> DataFrame:
    """(user_id, event_id, attempt, status, next_attempt_s) of delivery attempts at ts; a failed one waits twice as long as the one before."""
    wait = F.least(F.lit(LONGEST_WAIT_MIN), F.pow(F.lit(2), F.col("attempt") - 1)).cast("long")
    status = F.when(F.col("delivered"), "delivered").when(F.col("attempt") >= DELIVERY_ATTEMPTS, "delivery_failed").otherwise("retrying")
    return attempts.withColumn("status", status).select(
        "user_id", "event_id", "attempt", "status", F.when(F.col("status") == "retrying", F.floor(F.unix_micros("ts") / 1_000_000) + 60 * wait).cast("long").alias("next_attempt_s"))
