"""Appends to the operation log, judged one by one: the events of every operation, and beside many of them a request with a fault."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..model import Bundle
from ..operators import append_log
from ..operators.operations import TERMINAL
from ..registry import register
from .operation_log import FOLD, NOW_US

VERSION = "event/1"
_CLOSED = ", ".join(f"'{x}'" for x in TERMINAL)
#: Beside the event that a fault belongs to: 0 told again, 1 with another content, 2 with a wrong hash, 3 a number too far, 4 before its time, 5 after now, 6 of no operation,
#: 7 of another correlation, 8 of another schema, 9 with unsafe metadata, 10 without a number, 11 a creation.
FAULTS = 12
JUDGED = FOLD + f""", steps AS (SELECT e.operation_id, e.event_sequence n, e.event_type, w.status, w.error, p.status before, p.error error_before, e.event_us, t.t leads,
    (('0x' || substr(e.operation_id, 11, 6))::BIGINT + e.event_sequence * 7) % 17 k FROM ev e JOIN walk w ON w.operation_id = e.operation_id AND w.seen = e.event_sequence
    JOIN walk p ON p.operation_id = e.operation_id AND p.seen = e.event_sequence - 1 JOIN (SELECT DISTINCT e, t FROM rules) t ON t.e = e.event_type),
firsts AS (SELECT *, CASE WHEN error IS NULL THEN 'accepted' WHEN before IN ({_CLOSED}) THEN 'operation_closed' WHEN (before, event_type) NOT IN (SELECT (f, e) FROM rules) THEN 'invalid_transition' ELSE 'out_of_order' END o FROM steps),
told AS (SELECT operation_id || ':' || n request_id, o outcome, CASE WHEN o = 'accepted' THEN status END status FROM firsts
  UNION ALL SELECT operation_id || ':' || n || '+', CASE k WHEN 6 THEN 'operation_unknown' WHEN 7 THEN 'correlation_mismatch' WHEN 8 THEN 'schema_unsupported' WHEN 9 THEN 'metadata_unsafe' WHEN 10 THEN 'sequence_not_positive'
    WHEN 0 THEN CASE WHEN o = 'accepted' THEN 'replayed' ELSE o END WHEN 1 THEN CASE WHEN o = 'accepted' THEN 'sequence_conflict' ELSE o END
    WHEN 2 THEN CASE WHEN o IN ('accepted', 'out_of_order') THEN 'hash_mismatch' ELSE o END
    ELSE CASE WHEN status IN ({_CLOSED}) THEN 'operation_closed' WHEN k = 11 THEN 'invalid_transition' WHEN k = 3 OR o <> 'accepted' THEN 'out_of_order' WHEN k = 4 THEN 'backward_time' ELSE 'future_time' END END,
    CASE WHEN k = 0 AND o = 'accepted' THEN status END FROM firsts WHERE k < {FAULTS})"""


def _requests(b: Bundle) -> tuple[DataFrame, DataFrame]:
    e = b.operation_events.withColumn("correlation_id", F.concat(F.lit("correlation_"), F.substring("operation_id", 11, 12))).select(
        "operation_id", "correlation_id", "event_type", "event_sequence", "event_us", F.lit("collector").alias("source_component"), F.lit('{"stage":"capture"}').alias("metadata"), F.lit(VERSION).alias("schema_version"),
        sha256(F.concat_ws(":", "operation_id", "event_sequence")).alias("idempotency_key"))
    e = e.withColumn("request_id", F.concat_ws(":", "operation_id", "event_sequence")).withColumn("arrival", F.col("event_sequence") * 2)
    own = append_log.event_sha256(append_log.leads_to(F.col("event_type")))
    first = e.withColumn("submitted_sha256", F.when(F.col("event_sequence") % 2 == 1, own))
    k = (F.conv(F.substring("operation_id", 11, 6), 16, 10).cast("long") + F.col("event_sequence") * 7) % 17
    x = e.withColumn("k", k).where(F.col("k") < FAULTS).withColumn("request_id", F.concat("request_id", F.lit("+"))).withColumn("arrival", F.col("arrival") + 1)

    def at(*kinds: int):
        return F.col("k").isin(*kinds)

    n, us = F.col("event_sequence"), F.col("event_us")
    faulty = x.withColumns({
        "event_sequence": F.when(at(3), n + 2).when(at(4, 5, 11), n + 1).when(at(10), 0).otherwise(n).cast("long"),
        "event_type": F.when(at(3, 4, 5), "capture_interrupted").when(at(11), "operation_created").otherwise(F.col("event_type")),
        "event_us": F.when(at(4), us - 1_000_000).when(at(5), NOW_US + 2 * append_log.SKEW_US).otherwise(us),
        "source_component": F.when(at(1), "archive").otherwise(F.col("source_component")),
        "operation_id": F.when(at(6), F.concat("operation_id", F.lit("x"))).otherwise(F.col("operation_id")),
        "correlation_id": F.when(at(7), F.concat("correlation_id", F.lit("x"))).otherwise(F.col("correlation_id")),
        "schema_version": F.when(at(8), "event/2").otherwise(F.col("schema_version")),
        "metadata": F.when(at(9), '{"stage":"my password"}').otherwise(F.col("metadata")),
        "submitted_sha256": F.when(at(2), sha256(F.lit("other")))}).drop("k")
    return first.unionByName(faulty), e.select("operation_id", "correlation_id").distinct()


@register("i22_append_outcomes", "SELECT request_id, outcome, status FROM told", JUDGED)
def append_outcomes(b: Bundle):
    return append_log.appended(*_requests(b), NOW_US, VERSION).select("request_id", "outcome", "status")


@register("i22_append_counts", "SELECT outcome, count(*) n FROM told GROUP BY 1", JUDGED)
def append_counts(b: Bundle):
    return append_log.appended(*_requests(b), NOW_US, VERSION).groupBy("outcome").agg(F.count("*").alias("n"))


@register("k11_create_errors", """SELECT CAST(c_custkey AS VARCHAR) request_id, CASE c_custkey % 11 WHEN 1 THEN 'identifier_malformed' WHEN 2 THEN 'identifier_malformed' WHEN 3 THEN 'reference_not_opaque' WHEN 4 THEN 'reference_not_opaque'
 WHEN 5 THEN 'reference_not_opaque' WHEN 6 THEN 'operation_type_unknown' WHEN 7 THEN 'component_unknown' WHEN 8 THEN 'identifier_malformed' ELSE 'retries_itself' END error FROM customer WHERE c_custkey % 11 BETWEEN 1 AND 9""")
def create_errors(b: Bundle):
    k, name = F.col("c_custkey") % 11, F.regexp_replace("c_name", "#", ":")
    operation = F.when(k == 1, "short").otherwise(F.concat(F.lit("operation_"), name))
    rows = b.raw("customer").select(
        F.col("c_custkey").cast("string").alias("request_id"), operation.alias("operation_id"), F.when(k == 2, F.concat(F.lit("correlation "), name)).otherwise(F.concat(F.lit("correlation_"), name)).alias("correlation_id"),
        F.when(k == 3, "a/b").otherwise("web").alias("platform"), F.when(k == 4, "me@example.org").otherwise(name).alias("account_reference"),
        F.when(k == 5, "https://example.org/c").when(k == 10, F.lit(None)).otherwise(name).alias("conversation_reference"), F.when(k == 6, "export").otherwise("recapture").alias("operation_type"),
        F.when(k == 7, "mail").otherwise("collector").alias("source_component"), F.when(k == 8, "x").when(k == 9, operation).alias("parent_operation_id"))
    return append_log.create_errors(rows)
