"""Guards over pairs of old and new rows, completion rules of runs, and checks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What follows a system's own prefix in an external key.
EXTERNAL_KEY = r":(user|org|project):[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Kinds of candidates by extraction type.
KIND_OF_TYPE = {"decision": "decision", "requirement": "claim", "architecture_rule": "claim", "technical_finding": "claim", "sop": "sop", "task": "task",
                "unresolved_question": "idea", "proposal": "idea", "entity": "entity", "relationship": "relationship"}
# What each kind of guarded row must keep, what may not fall, and the states that may follow one another.
GUARDS = {
    "workspace": (["name", "record_sha256"], [], {"active": ("active", "suspended"), "suspended": ("suspended",)}),
    "quarantine": (["name", "record_sha256"], [], {"open": ("open", "released", "discarded"), "released": ("released",), "discarded": ("discarded",)}),
    "dead_letter": (["name", "record_sha256"], ["progress"], {}),
    "checkpoint": (["name"], ["progress"], {}),
}


def guarded(pairs: DataFrame) -> DataFrame:
    """(kind, row_id, error) of updates that a guard refuses: row_deleted, content_immutable, status_invalid or moved_backward, the first that holds.

    pairs: kind, row_id, and name, record_sha256, status and progress as they were (old_) and are (new_); new_name is null where a row was deleted.
    """
    def of_kind(kinds, condition: Column) -> Column:
        return F.col("kind").isin(list(kinds)) & condition

    def changed(c: str) -> Column:
        return ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))

    immutable = [of_kind([k for k, g in GUARDS.items() if c in g[0]], changed(c)) for c in ("name", "record_sha256")]
    legal = [f"{k}>{a}>{b}" for k, g in GUARDS.items() for a, to in g[2].items() for b in to]
    step = of_kind([k for k, g in GUARDS.items() if g[2]], ~F.concat_ws(">", "kind", "old_status", "new_status").isin(legal))
    back = of_kind([k for k, g in GUARDS.items() if g[1]], F.col("new_progress") < F.col("old_progress"))
    error = F.when(F.col("new_name").isNull(), "row_deleted").when(immutable[0] | immutable[1], "content_immutable").when(step, "status_invalid").when(back, "moved_backward")
    return pairs.withColumn("error", error).where("error is not null").select("kind", "row_id", "error")


# The codes of a capture run that is not complete, in order.
COMPLETION_CODES = ["expected_message_count_missing", "expected_content_block_count_missing", "expected_chunk_count_missing", "fatal_error_count_nonzero", "capture_missing",
                    "message_count_mismatch", "content_block_count_mismatch", "checkpoint_incomplete", "chunk_count_mismatch", "chunk_coverage_invalid",
                    "candidate_count_or_status_invalid", "provenance_resolution_invalid", "source_hash_resolution_invalid", "fatal_quarantine_open",
                    "fatal_dead_letter_present", "capture_verification_incomplete"]


def completion_errors(counted: DataFrame) -> DataFrame:
    """`counted` with errors: the codes of each run in order; run_missing alone without a run, none after capture_missing.

    Columns: has_run, has_capture, expected_* and actual counts (messages, blocks, chunks), fatal_errors, checkpoints, covered, proposed, resolved_edges,
    resolutions, open_quarantine, dead_letters and complete.  Counts that are null count as 0, expected ones that are null match nothing.
    """
    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    def differs(expected: str, actual: str) -> Column:
        return ~F.col(expected).eqNullSafe(n(actual))

    failed = dict(zip(COMPLETION_CODES, [
        F.col("expected_messages").isNull(), F.col("expected_blocks").isNull(), F.col("expected_chunks").isNull(), n("fatal_errors") != 0, ~F.col("has_capture"),
        differs("expected_messages", "messages"), differs("expected_blocks", "blocks"), n("checkpoints") != 1, differs("expected_chunks", "chunks"),
        ~F.coalesce(F.col("covered"), n("expected_messages") == 0), differs("expected_chunks", "proposed"), differs("expected_blocks", "resolved_edges"),
        1 + n("expected_messages") + n("expected_blocks") != n("resolutions"), n("open_quarantine") > 0, n("dead_letters") > 0, ~F.coalesce("complete", F.lit(False))]))
    codes = [F.when(c, code) for code, c in failed.items()]
    early = F.array_compact(F.array(*codes[:5]))
    errors = F.when(~F.col("has_run"), F.array(F.lit("run_missing"))).when(~F.col("has_capture"), early).otherwise(F.array_compact(F.array(*codes)))
    return counted.withColumn("errors", errors)


def ensure_request_errors(external_key: Column, name: Column, prefix: str = "core") -> Column:
    """invalid_body, or null where both are as they must be: exact lower-case identity after the prefix, no control characters, not padded, not too long."""
    def clean(text: Column, most: int) -> Column:
        return (F.length(text).between(1, most)) & (F.trim(text) == text) & ~text.rlike(r"[\x00-\x1f\x7f]")

    good = external_key.rlike(rf"^{prefix}{EXTERNAL_KEY}\z") & clean(external_key, 512) & clean(name, 256)
    return F.when(~F.coalesce(good, F.lit(False)), "invalid_body")


def candidate_kind(extraction_type: Column) -> Column:
    pairs = [x for pair in KIND_OF_TYPE.items() for x in map(F.lit, pair)]
    return F.try_element_at(F.create_map(*pairs), extraction_type)
