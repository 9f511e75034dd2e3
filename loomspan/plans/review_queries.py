"""Decisions on proposed candidates: two requests for each in one batch and a third one later, some of which a rule refuses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Bundle
from ..operators import review
from ..operators.validators import union
from ..registry import register
from ..shared import new_path, written
from ..sinks.versions import Store

MODULUS = 11
DECIDED = f"""cand AS (SELECT c.knowledge_candidate_id id, (c.conv_id * 3 + c.range_no) % {MODULUS} k, (SELECT count(*) FROM edges e WHERE e.knowledge_candidate_id = c.knowledge_candidate_id) n FROM candidates c),
told AS (SELECT 1 batch, id || ':0' request_id, CASE k WHEN 0 THEN 'reviewer_required' WHEN 1 THEN 'rationale_required' WHEN 2 THEN 'candidate_not_found' WHEN 3 THEN 'status_not_proposed' WHEN 4 THEN 'approval_without_evidence' WHEN 5 THEN 'approval_without_evidence' END error,
    CASE WHEN k = 6 THEN 'approved' WHEN k > 6 THEN 'rejected' END to_status, CASE WHEN k = 6 THEN n END n_edges FROM cand
  UNION ALL SELECT 1, id || ':1', CASE WHEN k = 2 THEN 'candidate_not_found' WHEN k = 3 THEN 'status_not_proposed' WHEN k = 5 THEN 'approval_without_evidence' WHEN k >= 6 THEN 'already_reviewed' END,
    CASE WHEN k = 0 THEN 'approved' WHEN k IN (1, 4) THEN 'rejected' END, CASE WHEN k = 0 THEN n END FROM cand
  UNION ALL SELECT 2, id || ':2', CASE k WHEN 2 THEN NULL WHEN 3 THEN 'status_not_proposed' WHEN 5 THEN 'approval_without_evidence' ELSE 'already_reviewed' END, CASE WHEN k = 2 THEN 'approved' END, CASE WHEN k = 2 THEN n END FROM cand)"""


def _candidates(b: Bundle) -> tuple[DataFrame, DataFrame]:
    k = (F.col("conv_id") * 3 + F.col("range_no")) % MODULUS
    c = b.candidates.select("workspace_id", F.col("knowledge_candidate_id").alias("candidate_id"), "kind", F.when(k == 3, "approved").otherwise("proposed").alias("status"), F.col("conv_id").alias("created_s"), k.alias("k"))
    evidence = b.edges.select(F.col("knowledge_candidate_id").alias("candidate_id"), "provenance_edge_id").join(c.where("k not in (4, 5)").select("candidate_id"), "candidate_id", "left_semi")
    return c, evidence


def _requests(c: DataFrame, place: int) -> DataFrame:
    k = F.col("k")
    to = {0: F.when((k >= 7) | (k == 1), "rejected").otherwise("approved"), 1: F.when(k.isin(1, 4, 6), "rejected").otherwise("approved"), 2: F.lit("approved")}[place]
    return c.select(F.concat_ws(":", "candidate_id", F.lit(place)).alias("request_id"), F.lit(place).alias("place"), F.when((k == 2) & F.lit(place < 2), F.concat(F.lit("x"), "candidate_id")).otherwise(F.col("candidate_id")).alias("candidate_id"),
                    to.alias("to_status"), F.when((k == 0) & F.lit(place == 0), " ").otherwise("me").alias("reviewer_id"), F.when((k == 1) & F.lit(place == 0), "").otherwise("because").alias("rationale"), F.lit(7).cast("long").alias("occurred_s"))


def _decided(b: Bundle) -> tuple[Store, list[DataFrame]]:
    c, evidence = _candidates(b)
    store = Store(b.spark, new_path(b.spark, "reviews"))
    batches = (_requests(c, 0).unionByName(_requests(c, 1)), _requests(c, 2))
    return store, [written(review.decide(store, f"batch:{i}", requests, c, evidence).withColumn("batch", F.lit(i)), "decisions") for i, requests in enumerate(batches, 1)]


@register("i8_decision_outcomes", "SELECT batch, request_id, error, to_status, n_edges FROM told", DECIDED)
def decision_outcomes(b: Bundle):
    return union(*_decided(b)[1])


@register("i8_open_candidates", "SELECT id candidate_id, CAST(CASE WHEN k = 5 THEN 0 ELSE n END AS BIGINT) evidence_count FROM cand WHERE k IN (3, 5)", DECIDED)
def open_candidates(b: Bundle):
    """What is still open after both batches, and what the store then shows of it."""
    store, _ = _decided(b)
    c, evidence = _candidates(b)
    return review.open_candidates(c, evidence, store.table(review.EVENTS)).select("candidate_id", "evidence_count")


@register("i8_approved_knowledge", "SELECT split_part(request_id, ':', 1) candidate_id, n_edges FROM told WHERE to_status = 'approved'", DECIDED)
def approved_knowledge(b: Bundle):
    store, _ = _decided(b)
    return store.table(review.APPROVED).select("candidate_id", F.size("provenance_edge_ids").cast("long").alias("n_edges"))
