"""Human review of proposed knowledge: one decision for each candidate, with a reviewer and a reason, and never changed after.

Requests of one batch are settled together: of those that nothing else refuses, the first of a candidate decides and the later ones find it decided.  An approval
needs evidence; one without it is refused whole, so the candidate stays open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_object, deterministic_id, sha256
from ..sinks.versions import COMMITTED, CONFLICT, REPLAYED, Store

EVENTS, APPROVED = "human_review_events", "approved_knowledge"
EVENT = "workspace_id string, human_review_event_id string, candidate_id string, reviewer_id string, to_status string, rationale string, occurred_s long, event_sha256 string"


def open_candidates(candidates: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(candidate_id, kind, created_s, evidence_count) of candidates that nobody has decided on."""
    counted = evidence.groupBy("candidate_id").agg(F.count("*").alias("evidence_count"))
    return candidates.join(events.select("candidate_id").distinct(), "candidate_id", "left_anti").join(counted, "candidate_id", "left") \
        .select("candidate_id", "kind", "created_s", F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"))


def judged(requests: DataFrame, candidates: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """`requests` (request_id, place, candidate_id, to_status, reviewer_id, rationale, occurred_s) with error and n_edges; error is null where the request decides."""
    counted = evidence.groupBy("candidate_id").agg(F.count_distinct("provenance_edge_id").alias("n_edges"))
    decided = events.select("candidate_id", F.lit(True).alias("decided")).distinct()
    known = candidates.select("candidate_id", "workspace_id", "status")
    told = requests.join(known, "candidate_id", "left").join(counted, "candidate_id", "left").join(decided, "candidate_id", "left")

    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    form = F.when(~F.coalesce(F.col("to_status").isin("approved", "rejected"), F.lit(False)), "decision_unknown").when(blank("reviewer_id"), "reviewer_required").when(blank("rationale"), "rationale_required") \
        .when(F.col("status").isNull(), "candidate_not_found").when(F.col("status") != "proposed", "status_not_proposed").when(F.col("decided"), "already_reviewed")
    bare = F.when((F.col("to_status") == "approved") & F.col("n_edges").isNull(), "approval_without_evidence")
    told = told.withColumn("form", form).withColumn("bare", bare)
    first = told.where("form is null and bare is null").groupBy("candidate_id").agg(F.min(F.struct("place", "request_id")).alias("first"))
    me = F.struct("place", "request_id")
    error = F.coalesce("form", F.when(F.col("first").isNotNull() & (me > F.col("first")), "already_reviewed"), "bare")
    return told.join(first, "candidate_id", "left").withColumn("error", error).drop("form", "bare", "first", "decided", "status")


def _rows(accepted: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    a = accepted.select("workspace_id", "candidate_id", F.trim("reviewer_id").alias("reviewer_id"), "to_status", F.trim("rationale").alias("rationale"), "occurred_s")
    a = a.withColumn("human_review_event_id", deterministic_id("human_review_event", F.col("workspace_id"), F.col("candidate_id")))
    names = ("workspace_id", "human_review_event_id", "candidate_id", "reviewer_id", "to_status", "rationale", "occurred_s")
    events = a.withColumn("event_sha256", sha256(canonical_object(**{c: F.col(c).cast("string") for c in names}))).select(*names, "event_sha256")
    edges = evidence.groupBy("candidate_id").agg(F.array_sort(F.collect_set("provenance_edge_id")).alias("provenance_edge_ids"))  # one candidate's own
    approved = a.where("to_status = 'approved'").join(edges, "candidate_id").select(
        "workspace_id", deterministic_id("approved_knowledge", F.col("workspace_id"), F.col("candidate_id")).alias("approved_knowledge_id"), "candidate_id", F.col("human_review_event_id").alias("approval_event_id"),
        "provenance_edge_ids", F.col("occurred_s").alias("approved_s"))
    return {EVENTS: events, APPROVED: approved}


def decide(store: Store, transaction_id: str, requests: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Record what may be recorded, events and approved knowledge together; (request_id, error, to_status, n_edges) of every request."""
    while True:
        base = store.version()
        known = EVENTS in {r.table for r in store.journal().select(F.explode("parts.table").alias("table")).distinct().collect()}
        events = store.table(EVENTS, base) if known else store.spark.createDataFrame([], EVENT)
        told = judged(requests, candidates, evidence, events)
        outcome = store.write(f"{transaction_id}:{base}", _rows(told.where("error is null"), evidence), base=base).outcome
        if outcome in (COMMITTED, REPLAYED):
            accepted = F.col("error").isNull()
            return told.select("request_id", "error", F.when(accepted, F.col("to_status")).alias("to_status"), F.when(accepted & (F.col("to_status") == "approved"), F.col("n_edges")).alias("n_edges"))
        if outcome != CONFLICT:
            raise ValueError(f"{transaction_id}: {outcome}")
