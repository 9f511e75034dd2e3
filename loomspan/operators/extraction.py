"""Rules of knowledge extraction runs: what their metadata must agree with, and when a run is complete.

Every rule is counted over its own tables by run, so no run is gathered; the counts meet at the end.  The tables, each a DataFrame:

    runs         run_id, status, manifest_sha256, expected_messages, expected_blocks, expected_chunks, fatal_errors
    extractions  run_id, capture_version_id, conversation_id, expected_candidates, expected_evidence, expected_ranges
    captures     capture_version_id, manifest_sha256
    conversations  conversation_id, capture_version_id
    verifications  capture_version_id, status
    messages     message_id, conversation_id, capture_version_id, sequence
    blocks       content_block_id, message_id, capture_version_id, representations (array of representation_kind, sha256)
    chunks       run_id, chunk_id, capture_version_id, message_ids, start_sequence, end_sequence
    candidates   candidate_id, chunk_id, status
    evidence     candidate_id, provenance_edge_id
    edges        provenance_edge_id, candidate_id, content_block_id, message_id, conversation_id, capture_version_id, representation_kind, representation_sha256
    resolutions  run_id, content_block_id, capture_version_id, expected_sha256, exact_match
    quarantine   run_id, fatal, status
    dead_letters run_id, fatal
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes of a run that is not complete, in order.
CODES = ("fatal_error_count_nonzero", "expected_message_count_missing", "expected_evidence_count_mismatch", "expected_evidence_range_count_mismatch", "source_capture_manifest_mismatch",
         "source_message_count_mismatch", "capture_verification_incomplete", "evidence_range_count_mismatch", "evidence_range_invalid", "candidate_count_or_status_invalid", "candidate_evidence_missing",
         "candidate_evidence_count_mismatch", "provenance_resolution_invalid", "orphan_provenance_edge", "fatal_quarantine_open", "fatal_dead_letter_present")
OPEN = ("pending", "running")


def _count(df: DataFrame, name: str, by: str = "run_id") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def completion_errors(t: dict[str, DataFrame], run_ids: DataFrame) -> DataFrame:
    """(run_id, errors) of the runs asked for: run_missing or extraction_metadata_missing alone, or the codes that hold, in order."""
    x = t["extractions"]
    chunks = t["chunks"].join(x.select("run_id", F.col("capture_version_id").alias("source")), "run_id")
    own_chunks = _count(chunks.where("capture_version_id = source"), "n_chunks")
    cited = chunks.select("run_id", "chunk_id", "source", "start_sequence", "end_sequence", F.explode("message_ids").alias("message_id"))
    known = t["messages"].select("message_id", F.col("capture_version_id").alias("source"), "sequence")
    strange = cited.join(known, ["message_id", "source"], "left").where("sequence is null or sequence not between start_sequence and end_sequence").select("run_id")
    bad_chunks = _count(chunks.where("capture_version_id <> source or coalesce(size(message_ids), 0) = 0").select("run_id").unionByName(strange), "bad_chunks")
    candidates = t["candidates"].join(t["chunks"].select("run_id", "chunk_id"), "chunk_id")
    backed = t["evidence"].join(candidates.select("run_id", "candidate_id"), "candidate_id")
    without = _count(candidates.join(t["evidence"].select("candidate_id").distinct(), "candidate_id", "left_anti"), "without_evidence")
    resolved = _count(_resolved(t, backed), "resolved")
    edges = t["edges"].join(candidates.select("run_id", "candidate_id"), "candidate_id")
    orphans = _count(edges.join(t["evidence"], ["candidate_id", "provenance_edge_id"], "left_anti"), "orphans")
    told = run_ids.select("run_id").distinct().join(t["runs"], "run_id", "left").join(x, "run_id", "left") \
        .join(t["captures"].select("capture_version_id", F.col("manifest_sha256").alias("source_manifest")), "capture_version_id", "left") \
        .join(_count(t["messages"], "n_messages", "capture_version_id"), "capture_version_id", "left") \
        .join(t["verifications"].where("status = 'complete'").select("capture_version_id").distinct().withColumn("verified", F.lit(True)), "capture_version_id", "left")
    for df in (own_chunks, bad_chunks, _count(candidates.where("status = 'proposed'"), "proposed"), without, _count(backed, "n_evidence"), resolved, orphans,
               _count(t["quarantine"].where("fatal and status = 'open'"), "quarantined"), _count(t["dead_letters"].where("fatal"), "dead")):
        told = told.join(df, "run_id", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    def differs(a: Column, b: Column) -> Column:
        return ~a.eqNullSafe(b)

    holds = (n("fatal_errors") != 0, F.col("expected_messages").isNull(), differs(F.col("expected_blocks"), F.col("expected_evidence")), differs(F.col("expected_chunks"), F.col("expected_ranges")),
             differs(F.col("manifest_sha256"), F.col("source_manifest")), differs(F.col("expected_messages"), n("n_messages")), F.col("verified").isNull(), n("n_chunks") != F.col("expected_ranges"), n("bad_chunks") > 0,
             n("proposed") != F.col("expected_candidates"), n("without_evidence") > 0, n("n_evidence") != F.col("expected_evidence"), n("resolved") != F.col("expected_evidence"), n("orphans") > 0,
             n("quarantined") > 0, n("dead") > 0)
    codes = F.array_compact(F.array(*(F.when(c, code) for code, c in zip(CODES, holds))))
    errors = F.when(F.col("status").isNull(), F.array(F.lit("run_missing"))).when(F.col("conversation_id").isNull(), F.array(F.lit("extraction_metadata_missing"))).otherwise(codes)
    return told.select("run_id", errors.alias("errors"))


def _resolved(t: dict[str, DataFrame], backed: DataFrame) -> DataFrame:
    """Evidence whose edge leads to a block of the run's own capture and conversation that has the cited representation, with an exact resolution."""
    x = t["extractions"].select("run_id", F.col("capture_version_id").alias("source"), F.col("conversation_id").alias("talk"))
    edges = t["edges"].withColumnRenamed("capture_version_id", "source").withColumnRenamed("conversation_id", "talk")
    held = backed.join(x, "run_id").join(edges, ["provenance_edge_id", "candidate_id", "source", "talk"])
    blocks = t["blocks"].select("content_block_id", "message_id", F.col("capture_version_id").alias("source"), "representations")
    has = F.exists("representations", lambda r: (r["representation_kind"] == F.col("representation_kind")) & (r["sha256"] == F.col("representation_sha256")))
    messages = t["messages"].select("message_id", F.col("conversation_id").alias("talk"), F.col("capture_version_id").alias("source"))
    exact = t["resolutions"].where("exact_match").select("run_id", "content_block_id", F.col("capture_version_id").alias("source"), F.col("expected_sha256").alias("representation_sha256"))
    return held.join(blocks, ["content_block_id", "message_id", "source"]).where(has).join(messages, ["message_id", "talk", "source"]).join(exact, ["run_id", "content_block_id", "source", "representation_sha256"])


def metadata_errors(t: dict[str, DataFrame], attached: DataFrame) -> DataFrame:
    """(run_id, error) of extraction metadata that may not be attached: the first rule that it breaks."""
    told = attached.select("run_id", "capture_version_id", "conversation_id").join(t["runs"].select("run_id", "status", "manifest_sha256"), "run_id", "left") \
        .join(t["captures"].select("capture_version_id", F.col("manifest_sha256").alias("source_manifest")), "capture_version_id", "left") \
        .join(t["conversations"].select("conversation_id", "capture_version_id").distinct().withColumn("own", F.lit(True)), ["conversation_id", "capture_version_id"], "left")
    error = F.when(F.col("status").isNull(), "base_run_missing").when(~F.col("status").isin(*OPEN), "run_not_open") \
        .when(~F.coalesce(F.col("source_manifest") == F.col("manifest_sha256"), F.lit(False)), "manifest_mismatch").when(F.col("own").isNull(), "conversation_not_in_capture")
    return told.select("run_id", error.alias("error")).where("error is not null")
