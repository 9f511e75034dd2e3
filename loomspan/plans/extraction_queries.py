"""An extraction run for every conversation, whole but for one planted fault in most of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..model import Bundle
from ..operators import extraction
from ..registry import register

MODULUS = 26
#: The codes that each planted fault gives, by the remainder of a conversation's number.
FAULTS = {
    1: "run_missing", 2: "extraction_metadata_missing", 3: "fatal_error_count_nonzero", 4: "expected_message_count_missing,source_message_count_mismatch", 5: "expected_evidence_count_mismatch",
    6: "expected_evidence_range_count_mismatch", 7: "source_capture_manifest_mismatch", 8: "source_message_count_mismatch", 9: "capture_verification_incomplete",
    10: "evidence_range_count_mismatch,candidate_count_or_status_invalid,candidate_evidence_count_mismatch,provenance_resolution_invalid", 11: "evidence_range_invalid", 12: "evidence_range_invalid",
    13: "candidate_count_or_status_invalid", 14: "candidate_evidence_missing,candidate_evidence_count_mismatch,provenance_resolution_invalid,orphan_provenance_edge", 15: "provenance_resolution_invalid",
    16: "orphan_provenance_edge", 17: "fatal_quarantine_open", 18: "fatal_dead_letter_present", 19: "provenance_resolution_invalid", 20: "provenance_resolution_invalid", 21: "evidence_range_count_mismatch,evidence_range_invalid",
}


def _tables(b: Bundle) -> dict[str, DataFrame]:
    k, first = F.col("conv_id") % MODULUS, F.col("range_no") == 0
    run = F.col("conversation_id").alias("run_id")
    captures = b.captures.select("conversation_id", "conv_id", "capture_version_id", "manifest_sha256", "n_messages")
    of = captures.select("conversation_id", "capture_version_id")
    n_blocks = b.blocks.groupBy("conversation_id").agg(F.count("*").alias("n_blocks"))
    n_ranges = b.ranges.groupBy("conversation_id").agg(F.count("*").alias("n_ranges"))
    counted = captures.join(n_blocks, "conversation_id").join(n_ranges, "conversation_id")
    runs = counted.where(k != 1).select(
        run, F.when(k == 22, "completed").otherwise("running").alias("status"), F.when(k == 7, F.lit("0" * 64)).otherwise(F.col("manifest_sha256")).alias("manifest_sha256"),
        F.when(k == 8, F.col("n_messages") + 1).when(k != 4, F.col("n_messages")).alias("expected_messages"), (F.col("n_blocks") + F.when(k == 5, 1).otherwise(0)).alias("expected_blocks"),
        (F.col("n_ranges") + F.when(k == 6, 1).otherwise(0)).alias("expected_chunks"), F.when(k == 3, 2).otherwise(0).alias("fatal_errors"))
    extractions = counted.where(k != 2).select(run, "capture_version_id", "conversation_id", F.col("n_ranges").alias("expected_candidates"), F.col("n_blocks").alias("expected_evidence"), F.col("n_ranges").alias("expected_ranges"))
    messages = b.messages.join(of, "conversation_id").select("message_id", "conversation_id", "capture_version_id", "sequence", "conv_id")
    ids = messages.withColumn("range_no", F.floor(F.col("sequence") / 5)).groupBy("conversation_id", "range_no").agg(F.array_sort(F.collect_list("message_id")).alias("ids"))  # five at most
    r = b.ranges.join(of, "conversation_id").join(ids, ["conversation_id", "range_no"])
    listed = F.when((k == 11) & first, F.array().cast("array<string>")).when((k == 12) & first, F.array(F.lit("message_gone"))).otherwise(F.col("ids"))
    chunks = r.where(~((k == 10) & first)).select(run, "chunk_id", F.when((k == 21) & first, "capture_other").otherwise(F.col("capture_version_id")).alias("capture_version_id"), listed.alias("message_ids"), "start_sequence", "end_sequence")
    candidates = b.candidates.select(F.col("knowledge_candidate_id").alias("candidate_id"), "chunk_id", F.when((k == 13) & first, "approved").otherwise("proposed").alias("status"))
    e = b.edges.join(captures.select("conversation_id", "conv_id", "capture_version_id"), "conversation_id")
    start = (F.col("sequence") == 0) & (F.col("block_sequence") == 0)
    e = e.join(b.blocks.select("content_block_id", "block_sequence"), "content_block_id")
    evidence = e.where(~((k == 14) & first)).select(F.col("knowledge_candidate_id").alias("candidate_id"), "provenance_edge_id")
    edge = e.select("provenance_edge_id", F.col("knowledge_candidate_id").alias("candidate_id"), "content_block_id", "message_id", F.when((k == 20) & start, "conversation_other").otherwise(F.col("conversation_id")).alias("conversation_id"),
                    "capture_version_id", "representation_kind", F.when((k == 19) & start, sha256(F.lit("other"))).otherwise(F.col("representation_sha256")).alias("representation_sha256"), (k.alias("k")), start.alias("start"))
    extra = edge.where("k = 16 and start").withColumn("provenance_edge_id", F.concat("provenance_edge_id", F.lit("x")))
    blocks = b.representations.join(of, "conversation_id").select("content_block_id", "message_id", "capture_version_id", "representations")
    resolutions = b.blocks.join(captures.select("conversation_id", "capture_version_id"), "conversation_id").select(
        run, "content_block_id", "capture_version_id", F.col("sha256").alias("expected_sha256"), (~((k == 15) & start)).alias("exact_match"))
    one = captures.select(run, "conv_id")
    return {
        "runs": runs, "extractions": extractions, "captures": captures.select("capture_version_id", "manifest_sha256"), "conversations": of, "messages": messages.drop("conv_id"), "blocks": blocks, "chunks": chunks, "candidates": candidates,
        "evidence": evidence, "edges": edge.unionByName(extra).drop("k", "start"), "resolutions": resolutions,
        "verifications": captures.select("capture_version_id", F.when(k == 9, "partial").otherwise("complete").alias("status")),
        "quarantine": one.where(k.isin(17, 23, 24)).select("run_id", (k != 23).alias("fatal"), F.when(k == 24, "released").otherwise("open").alias("status")),
        "dead_letters": one.where(k.isin(18, 25)).select("run_id", (k == 18).alias("fatal")),
    }


@register("v4_extraction_errors", f"SELECT conversation_id run_id, coalesce(f.codes, '') errors FROM captures c LEFT JOIN (VALUES {', '.join(f'''({k}, '{v}')''' for k, v in FAULTS.items())}) f(k, codes) ON f.k = c.conv_id % {MODULUS}")
def extraction_errors(b: Bundle):
    found = extraction.completion_errors(_tables(b), b.captures.select(F.col("conversation_id").alias("run_id")))
    return found.select("run_id", F.concat_ws(",", "errors").alias("errors"))


@register("v17_metadata_errors", f"""SELECT conversation_id run_id, CASE conv_id % {MODULUS} WHEN 1 THEN 'base_run_missing' WHEN 22 THEN 'run_not_open' WHEN 7 THEN 'manifest_mismatch' WHEN 23 THEN 'manifest_mismatch' ELSE 'conversation_not_in_capture' END error
FROM captures WHERE conv_id % {MODULUS} IN (1, 22, 7, 23, 24)""")
def metadata_errors(b: Bundle):
    """Metadata for every run; of two kinds it names another capture, or another conversation of its capture."""
    k = F.col("conv_id") % MODULUS
    attached = b.captures.select(F.col("conversation_id").alias("run_id"), F.when(k == 23, "capture_other").otherwise(F.col("capture_version_id")).alias("capture_version_id"),
                                 F.when(k == 24, "conversation_other").otherwise(F.col("conversation_id")).alias("conversation_id"))
    return extraction.metadata_errors(_tables(b), attached)
