"""The seventeen checks of a capture: each is a count of what breaks it over its own table, by conversation.

    captures     conversation_id
    messages     conversation_id, sequence, role, representations (array of kind, sha256), drift_kinds, structure_hashes
    blocks       conversation_id, type, representations
    citations    conversation_id
    attachments  conversation_id, message_id, locator, availability
    artifacts    conversation_id, message_id, locator
    branches     conversation_id, status, indicated, captured, restored
    evidence     conversation_id, portion
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Representations of a message or block, kinds of text, portions of evidence, and checks that are warnings.
REPRESENTATIONS, TEXTS, RENDERED = 4, ("inner_text", "text_content", "canonical_text"), "sanitized_html"
PORTIONS = {"evidence.initial": "initial_viewport", "evidence.earliest": "earliest_boundary", "evidence.latest": "latest_boundary"}
WARNINGS = ("representations.structure_stable", *PORTIONS)
MATERIAL = ("messages.present", "messages.sequenced", "roles.known", "representations.hashed", "representations.text_stable", "content_blocks.hashed", "transcript.count_matches", "code.preserved", "tables.preserved",
            "citations.recorded", "attachments.recorded", "artifacts.recorded", "branches.complete")


def _unhashed() -> Column:
    whole = F.forall("representations", lambda r: F.coalesce(r["sha256"].rlike(r"^[a-f0-9]{64}\z"), F.lit(False)))
    return ~F.coalesce((F.size("representations") >= REPRESENTATIONS) & whole, F.lit(False))


def _lacks(kind: str) -> Column:
    return ~F.coalesce(F.exists("representations", lambda r: r["kind"] == kind), F.lit(False))


def _blank(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c), F.lit("")) == "")
    return out


def checks(t: dict[str, DataFrame]) -> DataFrame:
    """(conversation_id, check_id, status, severity), seventeen rows for every capture."""
    drift = F.coalesce("drift_kinds", F.array().cast("array<string>"))
    unstable = F.array_contains(drift, RENDERED) & ~F.coalesce((F.size("structure_hashes") >= 0) & (F.size(F.array_distinct("structure_hashes")) <= 1), F.lit(False))
    m = t["messages"].groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count_distinct("sequence").alias("places"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_if(F.col("role") == "unknown").alias("unknown_roles"),
        F.count_if(_unhashed()).alias("unhashed"), F.count_if(F.arrays_overlap(drift, F.array(*map(F.lit, TEXTS)))).alias("drifted"), F.count_if(unstable).alias("unstable"))
    kind = F.col("type")
    b = t["blocks"].groupBy("conversation_id").agg(
        F.count_if(_unhashed()).alias("unhashed_blocks"), F.count_if((kind == "code") & (_lacks("text_content") | _lacks(RENDERED))).alias("lost_code"),
        F.count_if((kind == "table") & (_lacks("inner_text") | _lacks(RENDERED))).alias("lost_tables"), F.count_if(kind == "link").alias("links"))
    cited = t["citations"].groupBy("conversation_id").agg(F.count("*").alias("citations"))
    attached = t["attachments"].groupBy("conversation_id").agg(F.count_if(_blank("message_id", "locator", "availability")).alias("bad_attachments"))
    made = t["artifacts"].groupBy("conversation_id").agg(F.count_if(_blank("message_id", "locator")).alias("bad_artifacts"))
    whole = (F.col("status") == "captured") & ((F.coalesce("indicated", F.lit(0)) == 0) | (F.col("captured") >= F.col("indicated"))) & F.col("restored")
    branches = t["branches"].groupBy("conversation_id").agg(F.count_if(~F.coalesce(whole, F.lit(False))).alias("open_branches"))
    seen = t["evidence"].groupBy("conversation_id").agg(*(F.count_if(F.col("portion") == p).alias(p) for p in PORTIONS.values()))
    told = t["captures"].select("conversation_id")
    for df in (m, b, cited, attached, made, branches, seen):
        told = told.join(df, "conversation_id", "left")

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    contiguous = (n("n") == 0) | ((F.col("places") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1))
    passed = dict(zip(MATERIAL, (n("n") > 0, contiguous, n("unknown_roles") == 0, n("unhashed") == 0, n("drifted") == 0, n("unhashed_blocks") == 0, n("places") == n("n"), n("lost_code") == 0, n("lost_tables") == 0,
                                 n("citations") >= n("links"), n("bad_attachments") == 0, n("bad_artifacts") == 0, n("open_branches") == 0)))
    passed |= {WARNINGS[0]: n("unstable") == 0, **{c: n(p) > 0 for c, p in PORTIONS.items()}}
    rows = F.array(*(F.struct(F.lit(c).alias("check_id"), F.when(ok, "pass").otherwise("fail").alias("status"), F.lit("warning" if c in WARNINGS else "material").alias("severity")) for c, ok in passed.items()))
    return told.select("conversation_id", F.explode(rows).alias("c")).select("conversation_id", "c.*")


def status(found: DataFrame) -> DataFrame:
    """(conversation_id, status, n_failed): needs_review where a material check failed, partial where only warnings did, else complete."""
    failed, material = F.col("status") == "fail", F.col("severity") == "material"
    return found.groupBy("conversation_id").agg(
        F.when(F.count_if(failed & material) > 0, "needs_review").when(F.count_if(failed) > 0, "partial").otherwise("complete").alias("status"), F.count_if(failed).alias("n_failed"))
