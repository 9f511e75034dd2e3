"""Queries over operation events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import EPOCH, PRELUDE, Bundle  # noqa: F401
from ..operators import operations
from ..registry import register

NOW_US = 1_800_000_000_000_000
_STEPS = ", ".join(f"'{x}'" for x in operations.LIFECYCLE)
_N = len(operations.LIFECYCLE)
EVENTS = f"""ev0 AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) event_us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n FROM events),
ev1 AS (SELECT *, n // {_N} AS cyc, n % {_N} + 1 event_sequence FROM ev0),
ev AS (SELECT 'operation_' || substr(sha256(user_id || ':' || cyc), 1, 32) operation_id, event_sequence,
  CASE WHEN user_id % 17 = 0 AND event_sequence = 4 THEN 'capture_completed' ELSE list_extract([{_STEPS}], event_sequence) END event_type,
  event_us, 'component_' || (event_sequence % 3) source_component FROM ev1)"""
_RULES = " UNION ALL ".join(f"SELECT '{s}' f, '{e}' e, '{to}' t" for e, (states, to) in operations.TRANSITIONS.items() for s in states)
FOLD = EVENTS + f""", rules AS ({_RULES}),
walk AS (SELECT * FROM (WITH RECURSIVE w AS (
  SELECT operation_id, CAST(0 AS BIGINT) seen, '' status, CAST(NULL AS VARCHAR) error FROM (SELECT DISTINCT operation_id FROM ev)
  UNION ALL
  SELECT w.operation_id, w.seen + 1, CASE WHEN w.error IS NULL AND r.t IS NOT NULL THEN r.t ELSE w.status END,
    CASE WHEN w.error IS NOT NULL THEN w.error WHEN r.t IS NULL THEN 'invalid_transition:' || e.event_type END
  FROM w JOIN ev e ON e.operation_id = w.operation_id AND e.event_sequence = w.seen + 1 LEFT JOIN rules r ON r.f = w.status AND r.e = e.event_type)
  SELECT * FROM w)),
folded AS (SELECT operation_id, arg_max(status, seen) status, arg_max(error, seen) error, max(seen) n_events FROM walk GROUP BY 1)"""


@register("i21_operation_fold", """SELECT f.operation_id, f.status, f.error, f.n_events, e.event_type last_event_type
FROM (SELECT operation_id, arg_max(status, seen) status, max(error) error, max(seen) n_events FROM walk GROUP BY 1) f
JOIN ev e ON e.operation_id = f.operation_id AND e.event_sequence = f.n_events""", FOLD)
def operation_fold(b: Bundle):
    return operations.fold(b.operation_events)


@register("k21_status_report", f"""SELECT f.operation_id, f.status, f.error, f.n_events, e.event_type last_event_type, g.capture_started, g.identity_verified, g.delivered, g.archived, g.verified, g.last_event_us,
  CAST(CASE WHEN f.status NOT IN ('completed','needs_review','failed','interrupted','canceled') AND {NOW_US} - g.last_event_us >= 900000000 THEN 1 ELSE 0 END AS INTEGER) stuck,
  CAST(CASE WHEN f.status IN ('failed','interrupted','canceled') THEN 1 ELSE 0 END AS INTEGER) retry_safe
FROM (SELECT operation_id, arg_max(status, seen) status, max(error) error, max(seen) n_events FROM walk GROUP BY 1) f
JOIN ev e ON e.operation_id = f.operation_id AND e.event_sequence = f.n_events
JOIN (SELECT operation_id, max(CAST(event_type = 'capture_started' AS INTEGER)) capture_started, max(CAST(event_type = 'identity_verified' AS INTEGER)) identity_verified,
  max(CAST(event_type = 'collector_delivery_succeeded' AS INTEGER)) delivered, max(CAST(event_type = 'archive_completed' AS INTEGER)) archived,
  max(CAST(event_type = 'verification_completed' AS INTEGER)) verified, max(event_us) last_event_us FROM ev GROUP BY 1) g ON g.operation_id = f.operation_id""", FOLD)
def status_report(b: Bundle):
    return operations.status_report(b.operation_events, NOW_US)


@register("c15_current_event", "SELECT e.operation_id, e.event_sequence, e.event_type, e.source_component FROM ev e JOIN (SELECT operation_id, max(event_sequence) m FROM ev GROUP BY 1) x ON x.operation_id = e.operation_id AND x.m = e.event_sequence", EVENTS)
def current_event(b: Bundle):
    e = b.operation_events
    last = e.groupBy("operation_id").agg(F.max("event_sequence").alias("event_sequence"))
    return e.join(last, ["operation_id", "event_sequence"]).select("operation_id", "event_sequence", "event_type", "source_component")


@register("w7_latest_operation", "SELECT source_component, operation_id, event_sequence, event_us FROM (SELECT *, row_number() OVER (PARTITION BY source_component ORDER BY event_us DESC, operation_id) rn FROM ev) WHERE rn = 1", EVENTS)
def latest_operation(b: Bundle):
    n = F.row_number().over(Window.partitionBy("source_component").orderBy(F.desc("event_us"), "operation_id"))
    return b.operation_events.withColumn("rn", n).where("rn = 1").select("source_component", "operation_id", "event_sequence", "event_us")


@register("w8_last_component", "SELECT operation_id, arg_max(source_component, event_sequence) newest, arg_min(source_component, event_sequence) FILTER (WHERE event_sequence > 1) oldest_after_first FROM ev GROUP BY 1", EVENTS)
def last_component(b: Bundle):
    return b.operation_events.groupBy("operation_id").agg(
        F.max_by("source_component", "event_sequence").alias("newest"),
        F.min_by(F.when(F.col("event_sequence") > 1, F.col("source_component")), F.when(F.col("event_sequence") > 1, F.col("event_sequence"))).alias("oldest_after_first"))


@register("j1_order_violations", """SELECT code, operation_id record_id, CAST(event_sequence AS VARCHAR) message FROM (
  SELECT operation_id, event_sequence, unnest(list_filter([CASE WHEN event_us < lag(event_us) OVER (PARTITION BY operation_id ORDER BY event_sequence) THEN 'backward_time' END,
    CASE WHEN event_us > 1700000300000000 THEN 'future_time' END], lambda x: x IS NOT NULL)) code FROM ev)""", EVENTS)
def order_violations(b: Bundle):
    return operations.order_violations(b.operation_events, 1_700_000_000_000_000)


@register("o8_recent_operations", "SELECT operation_id, event_sequence, event_type, event_us FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY event_sequence DESC) rn FROM ev) WHERE rn = 1 ORDER BY event_us DESC, operation_id LIMIT 5", EVENTS)
def recent_operations(b: Bundle):
    last = b.operation_events.groupBy("operation_id").agg(F.max_by(F.struct("event_sequence", "event_type", "event_us"), "event_sequence").alias("e"))
    return last.select("operation_id", "e.*").orderBy(F.desc("event_us"), "operation_id").limit(5)


@register("g22_needs_you", "SELECT CAST(sum(CAST(n >= 10 AS INTEGER)) AS BIGINT) long_logs, CAST(count(*) AS BIGINT) operations, CAST(sum(n) AS BIGINT) total_events FROM (SELECT operation_id, count(*) n FROM ev GROUP BY 1)", EVENTS)
def needs_you(b: Bundle):
    n = b.operation_events.groupBy("operation_id").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") >= 10).alias("long_logs"), F.count("*").alias("operations"), F.sum("n").alias("total_events"))


@register("j6_retry_backoff", """SELECT user_id, event_id, attempt, CASE WHEN delivered THEN 'delivered' WHEN attempt >= 20 THEN 'delivery_failed' ELSE 'retrying' END status,
CASE WHEN NOT delivered AND attempt < 20 THEN epoch_us(ts) // 1000000 + 60 * CAST(least(30, pow(2, attempt - 1)) AS BIGINT) END next_attempt_s FROM (
SELECT user_id, event_id, CAST(ts AS TIMESTAMP) ts, event_id % 29 = 0 delivered, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 23 + 1 attempt FROM events) WHERE attempt <= 20""")
def retry_backoff(b: Bundle):
    """Deliveries of a user's handoffs, each tried until it is delivered or has failed for good."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    tried = b.raw("events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 29 == 0).alias("delivered"), (n % 23 + 1).cast("long").alias("attempt"))
    return operations.delivery(tried.where(F.col("attempt") <= operations.DELIVERY_ATTEMPTS))
