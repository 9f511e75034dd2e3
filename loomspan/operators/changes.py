"""Comparison, classification and planning over versions of captures and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_unique(prior: DataFrame, current: DataFrame, keys: list[str], prior_id: str, current_id: str) -> DataFrame:
    """(prior_id, current_id, matched_by): each key in turn matches rows whose value is unique on both sides; what is matched leaves the next stage."""
    out = None
    for key in keys:
        one = prior.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(prior_id).alias(prior_id)).where("_n = 1").drop("_n")
        two = current.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(current_id).alias(current_id)).where("_n = 1").drop("_n")
        found = one.join(two, key).select(prior_id, current_id, F.lit(key).alias("matched_by"))
        out = found if out is None else out.unionByName(found)
        prior = prior.join(found.select(prior_id), prior_id, "left_anti")
        current = current.join(found.select(current_id), current_id, "left_anti")
    return out


def compare_versions(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(conversation_id, sequence, change) of messages (conversation_id, sequence, role, text_sha256) of two captures."""
    a = prior.select("conversation_id", "sequence", F.col("role").alias("ra"), F.col("text_sha256").alias("ha"))
    b = current.select("conversation_id", "sequence", F.col("role").alias("rb"), F.col("text_sha256").alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ra") != F.col("rb"), "role_changed") \
        .when(F.col("ha") != F.col("hb"), "content_changed").otherwise("unchanged")
    return a.join(b, ["conversation_id", "sequence"], "full").select("conversation_id", "sequence", change.alias("change"))


def classify_discovered(discovered: DataFrame, known: DataFrame, account_established: bool = True, complete: bool = True) -> DataFrame:
    """(item_id, classification, reasons) by ordered rules; discovered has item_id, source_native_id, title, review_status,
    known has source_native_id, verification_status, title, ambiguous."""
    k = known.select("source_native_id", F.col("verification_status").alias("vs"), F.col("title").alias("kt"), "ambiguous", F.lit(True).alias("hit"))
    flagged = F.when(F.col("review_status") == "needs_review", "discovery_flagged_item_for_review")
    vs, hit = F.col("vs"), F.col("hit").isNotNull()

    def result(kind: str, *reasons) -> Column:
        return F.struct(F.lit(kind).alias("classification"), F.array_join(F.array_compact(F.array(*[r if isinstance(r, Column) else F.lit(r) for r in reasons])), ",").alias("reasons"))

    out = F.when(F.lit(not account_established), result("needs_review", "opaque_account_reference_not_established")) \
        .when(F.col("source_native_id").isNull(), result("needs_review", "unstable_item_identity")) \
        .when(~hit & F.lit(not complete), result("needs_review", flagged, "incomplete_discovery_cannot_conclude_absence")) \
        .when(~hit & flagged.isNotNull(), result("needs_review", flagged, "no_matching_source_record")) \
        .when(~hit, result("never_captured", "no_matching_source_record")) \
        .when(F.col("ambiguous"), result("needs_review", flagged, "several_records")) \
        .when(vs.isNull(), result("needs_review", flagged, "matched_without_capture_version")) \
        .when(vs.isin("failed", "needs_review"), result("needs_review", flagged, F.concat(F.lit("capture_verification_status:"), vs))) \
        .when(flagged.isNotNull(), result("needs_review", flagged)) \
        .when(F.col("kt") != F.col("title"), result("possibly_changed", "visible_title_differs_from_captured_title")) \
        .when(vs == "partial", result("captured_partial", "capture_verification_status:partial")) \
        .otherwise(result("captured_verified", "capture_verification_status:complete", "visible_title_unchanged"))
    return discovered.join(k, "source_native_id", "left").select("item_id", out.alias("r")).select("item_id", "r.*")


def catalog_changes(before: DataFrame, observed: DataFrame, key: str = "conversation_id", fingerprint: str = "fingerprint") -> DataFrame:
    """(key, classification) of a complete inventory against the latest state: what is not observed is missing, never deleted."""
    a = before.select(key, F.col(fingerprint).alias("_a"))
    b = observed.select(key, F.col(fingerprint).alias("_b"), "review_status")
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("review_status") == "needs_review", "needs_review").when(F.col("_a").isNull(), "new") \
        .when(F.col("_a") == F.col("_b"), "unchanged").otherwise("possibly_changed")
    return a.join(b, key, "full").select(key, kind.alias("classification"))


def plan_reconciliation(found: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): add, already_present (same hash) or needs_review (another hash, or found twice)."""
    twice = F.count("*").alias("_n")
    one = found.groupBy(key).agg(twice, F.min(digest).alias("_d"))
    return one.join(known.select(key, F.col(digest).alias("_k")), key, "left").select(
        key, F.when(F.col("_n") > 1, "needs_review").when(F.col("_k").isNull(), "add").when(F.col("_k") == F.col("_d"), "already_present").otherwise("needs_review").alias("action"))
