"""Provenance: joins from approved knowledge and candidates to the exact block that supports them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Bundle


def evidence_lines(b: Bundle) -> DataFrame:
    """Every edge with the representation that it names: kind and hash of one of the block's representations."""
    rep = b.representations.select("content_block_id", "role", F.explode("representations").alias("rep"))
    named = rep.select("content_block_id", "role", F.col("rep.representation_kind").alias("kind"), F.col("rep.sha256").alias("digest"), F.col("rep.value").alias("text_value"))
    return b.edges.join(named, "content_block_id").where((F.col("kind") == F.col("representation_kind")) & (F.col("digest") == F.col("representation_sha256"))) \
        .drop("kind", "digest")


def approved_evidence(b: Bundle) -> DataFrame:
    """Evidence lines of approved knowledge, with its review and capture."""
    captures = b.captures.select("conversation_id", "capture_version_id")
    reviews = b.reviews.select("human_review_event_id", "reviewer_id", F.col("to_status").alias("review_status"))
    return b.approved.drop("workspace_id").join(reviews, F.col("approval_event_id") == F.col("human_review_event_id")) \
        .join(evidence_lines(b), "knowledge_candidate_id").join(captures, "conversation_id")


def approved_query(b: Bundle, term: str, limit: int = 20) -> DataFrame:
    """Approved knowledge whose cited evidence holds a term, newest first; the limit is held between 1 and 100."""
    return approved_evidence(b).where(F.contains(F.lower("text_value"), F.lit(term.lower()))).select(
        "approved_knowledge_id", "knowledge_candidate_id", "approved_s", "reviewer_id", "review_status", "capture_version_id", "conversation_id",
        "message_id", "sequence", "role", "provenance_edge_id", "text_value").distinct() \
        .orderBy(F.desc("approved_s"), "sequence", "provenance_edge_id").limit(min(100, max(1, limit)))


def first_evidence(lines: DataFrame, key: str) -> DataFrame:
    """One line for each key: the first by sequence and edge."""
    order = Window.partitionBy(key).orderBy("sequence", "provenance_edge_id")
    return lines.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def undecided(b: Bundle) -> DataFrame:
    """Proposed candidates without a review event."""
    return b.candidates.where("status = 'proposed'").join(b.reviews.select("knowledge_candidate_id"), "knowledge_candidate_id", "left_anti")


def trusted_candidates(b: Bundle) -> DataFrame:
    """Candidates with an edge and without an edge that is not trusted; edges of failed captures are not."""
    good = b.captures.where("verification_status <> 'failed'").select("conversation_id")
    raw = b.edges.select("provenance_edge_id", "knowledge_candidate_id", "conversation_id")
    untrusted = raw.join(raw.join(good, "conversation_id", "left_semi").select("provenance_edge_id"), "provenance_edge_id", "left_anti")
    return b.candidates.join(raw.select("knowledge_candidate_id"), "knowledge_candidate_id", "left_semi") \
        .join(untrusted.select("knowledge_candidate_id"), "knowledge_candidate_id", "left_anti")


def insert_or_verify(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, outcome): inserted, existing (same hash) or conflict (another hash)."""
    both = incoming.select(key, digest).join(stored.select(key, F.col(digest).alias("_stored")), key, "left")
    return both.select(key, F.when(F.col("_stored").isNull(), "inserted").when(F.col("_stored") == F.col(digest), "existing").otherwise("conflict").alias("outcome"))
